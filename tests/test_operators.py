"""Scenarios, edges and invariants of the routing operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.operators import metadata as md
from pathweave.operators import outcomes as oc
from pathweave.operators import topology as tp
from pathweave.operators import validation as va
from pathweave.plans.views import load
from pathweave.sources import commits, serving, sinks, text
from pathweave.streaming import incremental as inc

P, S = "172.20.0.0/16", "172.20.9.0/24"
FORWARDING = [
    (118, P, 310, 205), (205, P, 310, 310), (207, P, 310, 205), (310, P, 310, 64514), (913, P, 310, 207),
    (205, S, 913, 207), (207, S, 913, 913), (310, S, 913, 64514), (913, S, 913, 64513),
]


def _prefixed(spark, rows, schema, col="prefix"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn(col, px.parse(F.col(col)))


def test_hijack_scenario(spark):
    fwd = _prefixed(spark, FORWARDING, "asn long, prefix string, origin long, received_from_asn long")
    best = va.most_specific_per_as(fwd)
    kept = {(r.asn, r.len) for r in best.select("asn", "prefix.len").collect()}
    assert kept == {(118, 16), (205, 24), (207, 24), (310, 24), (913, 24)}
    traced = oc.trace_back(best)
    assert {r.asn: r.condition for r in traced.collect()} == {118: "hijacked", 205: "hijacked", 207: "hijacked", 913: "hijacked", 310: "not_hijacked"}
    counts = oc.data_plane_counts(traced.where("asn not in (310, 913)").withColumn("implement", F.lit(False))).first()
    assert (counts.hijacked, counts.not_hijacked, counts.blackholed, counts.total) == (3, 0, 0, 3)


def test_trace_of_64_hops_and_loop(spark):
    chain = [(i, i + 1) for i in range(1, 64)] + [(64, 64512)] + [(900, 901), (901, 900)]
    out = {r.asn: r.condition for r in oc.trace_back(spark.createDataFrame(chain, "asn long, received_from_asn long")).collect()}
    assert out[1] == "blackholed" and out[900] is None
    loops = oc.loop_report(spark.createDataFrame([*chain, (950, 951), (951, 952)], "asn long, received_from_asn long"))
    assert {r.asn: (r.next, r.path) for r in loops.collect()} == {
        900: (900, [900, 901] * 32), 901: (901, [901, 900] * 32), 950: (952, [950, 951]), 951: (952, [951])
    }


def test_percent_index_check_fails(spark):
    good = spark.createDataFrame([(0, 10), (0, 10), (1, 20), (2, None)], "percent_iter int, percent int")
    assert oc.require_percent_index(good) is good
    # One percent under two iterations is the fault; two percents under one iteration are none.
    assert oc.check_percent_index(good.unionByName(good.where("percent_iter = 1").withColumn("percent", F.lit(30)))).count() == 0
    with pytest.raises(ValueError, match=r"\[20\]"):
        oc.require_percent_index(good.unionByName(good.where("percent_iter = 1").withColumn("percent_iter", F.lit(7))))


def _trial(spark):
    attack = ("subprefix", 1, 913, [S], 310, [P], "ROV", 30, 1, 0, None, None, None, None, None)
    info = spark.createDataFrame([(1, *attack), (2, *attack)], "trial long, attack_type string, number_of_attackers long, attacker_asn long, attacker_prefixes array<string>, victim long, victim_prefixes array<string>, adopt_pol string, percent long, percent_iter long, round_num long, extra_bash_arg_1 long, extra_bash_arg_2 long, extra_bash_arg_3 long, extra_bash_arg_4 long, extra_bash_arg_5 long")
    info = info.withColumns({c: F.transform(c, px.parse) for c in ("attacker_prefixes", "victim_prefixes")})
    best = va.most_specific_per_as(_prefixed(spark, FORWARDING, "asn long, prefix string, origin long, received_from_asn long"))
    forwarding = best.withColumn("trial", F.lit(1).cast("long"))
    rows = [(1, asn, "edge", asn == 207) for asn in (118, 207, 205, 913, 310, 5)] + [(1, 205, "top", None), (2, 118, "edge", False)]
    return info, spark.createDataFrame(rows, "trial long, asn long, subtable_name string, implement boolean"), forwarding


def test_trial_facts_of_a_scenario(spark):
    info, segments, forwarding = _trial(spark)
    facts = oc.trial_facts(info, segments, forwarding)
    assert set(facts.columns) >= {*oc.TRIAL_INFO, "subtable_name", "visible_hijacks_adopting"} and len(facts.columns) == 35
    rows = {(r.trial, r.subtable_name): r for r in facts.collect()}
    edge = rows[1, "edge"]
    # 118, 207 and 205 end at the attacker; 118 holds only the victim's prefix; AS 5 has no RIB; attacker and victim don't count.
    assert (edge.trace_hijacked_adopting, edge.trace_hijacked_collateral, edge.no_rib_collateral, edge.trace_total_adopting, edge.trace_total_collateral) == (1, 2, 1, 1, 3)
    assert (edge.c_plane_has_attacker_prefix_origin_adopting, edge.c_plane_has_attacker_prefix_origin_collateral, edge.c_plane_has_only_victim_prefix_origin_collateral) == (1, 1, 1)
    # The next hops of 118 (205), 207 and 205 (913) hold the attacker's prefix.
    assert (edge.visible_hijacks_adopting, edge.visible_hijacks_collateral) == (1, 2)
    assert (rows[1, "top"].trace_hijacked_collateral, rows[1, "top"].trace_total_adopting) == (1, 0)
    assert (rows[2, "edge"].no_rib_collateral, rows[2, "edge"].trace_total_collateral, rows[2, "edge"].visible_hijacks_collateral) == (1, 1, 0)
    (rates,) = oc.trial_rates(facts).collect()
    assert (rates.trace_hijacked_collateral, rates.trace_disconnected_collateral, rates.hidden_hijacks_collateral, rates.c_plane_connected_collateral) == (2 / 3, 1 / 3, 0.0, 1 / 3)
    means = oc.mean_ci95(oc.trial_rates(facts))
    series = oc.plot_series(means, "percent", [30], {"extra_bash_arg_1": None, "subtable_name": "edge"}, ["ROV"])
    assert series.count() == len(oc.MEASURES) == 16 and oc.plot_series(means, "percent", [30], {"round_num": None}).count() == 0


def test_trial_facts_without_rows(spark):
    info, segments, forwarding = _trial(spark)
    assert oc.trial_facts(info, segments.limit(0), forwarding).count() == 0
    blind = oc.trial_facts(info, segments, forwarding.limit(0)).where("trial = 1 and subtable_name = 'edge'").first()
    assert (blind.no_rib_collateral, blind.no_rib_adopting, blind.trace_total_collateral, blind.trace_hijacked_adopting) == (3, 1, 3, 0)


def test_semi_containment_keeps_equal_rows(spark):
    rows = _prefixed(spark, [("10.1.0.0/16", 1), ("10.1.0.0/16", 1), ("11.0.0.0/8", 2), (None, 3)], "prefix string, origin long")
    covering = _prefixed(spark, [("10.0.0.0/8", 1), ("10.1.0.0/16", 1)], "prefix string, asn long")
    assert [r.origin for r in px.containment_join(rows, covering.select("prefix"), how="left_semi").collect()] == [1, 1]


def test_best_and_worst_validity(spark):
    pairs = _prefixed(spark, [("10.0.0.0/16", 1), ("10.1.0.0/16", 2), ("11.0.0.0/8", 1), (None, 5)], "prefix string, origin long")
    roas = _prefixed(spark, [(1, "10.0.0.0/8", 12), (9, "10.0.0.0/12", 12), (2, "10.1.0.0/16", 16), (7, "10.1.0.0/16", 16)], "asn long, prefix string, max_length int")
    codes = va.known_validity(pairs, roas)
    by = lambda df: {r.origin: r.validity for r in df.where("prefix is not null").collect() if r.origin in (1, 2) or True}
    best = {(px_text, r.validity) for r in va.best_validity(codes).collect() for px_text in [(r.prefix.lo >> 16, r.origin)]}
    assert best == {((0x0A00, 1), 2), ((0x0A01, 2), 0)}
    worst = {((r.prefix.lo >> 16, r.origin), r.validity) for r in va.worst_validity(pairs.where("prefix is not null"), codes).collect()}
    assert worst == {((0x0A00, 1), 4), ((0x0A01, 2), 0), ((0x0B00, 1), 1)}
    assert by(va.all_validity(va.distinct_pairs(pairs), va.best_validity(codes)))[1] in (1, 2)


def _most_rows(df):
    """The largest number of rows that a step of the run plan gave out."""
    plan, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    plan.executeCollect()
    todo.append(plan)
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
    return most


def test_validity_of_pairs_below_many_roas(spark):
    """3,000 ROAs around 2,000 pairs don't meet as six million rows."""
    pairs = spark.range(2000).select(px.make(4, 0, 0x0A000000 + F.col("id") * 256, F.lit(24)).alias("prefix"), (F.col("id") % 50).alias("origin"))
    roas = spark.range(3000).select((F.col("id") % 40 + 5).alias("asn"), px.make(4, 0, 0x0A000000, 8 + F.col("id").cast("int") % 4).alias("prefix"), (8 + F.col("id") % 11).cast("int").alias("max_length"))
    roas = roas.unionByName(spark.range(1).select(F.lit(49).cast("long").alias("asn"), px.make(4, 0, 0x0A000000, 9).alias("prefix"), F.lit(24).alias("max_length")))
    found = va.validated_pairs(pairs, roas)
    assert _most_rows(found) < 20000
    assert {(r.origin, r.validity): r.n for r in found.groupBy("origin", "validity").agg(F.count("*").alias("n")).collect()} == {(o, 3 if o < 5 or 45 <= o < 49 else 0 if o == 49 else 2): 40 for o in range(50)}


def test_validity_equals_that_of_each_roa_with_nulls_and_both_families(spark):
    rnd = random.Random(11)
    text_of = lambda: rnd.choice([f"10.{rnd.randint(0, 3)}.0.0/{rnd.choice([8, 10, 12, 15, 16, 24])}", f"2001:db8:{rnd.randint(0, 3)}::/{rnd.choice([20, 32, 46, 48, 64])}", None, "11.0.0.0/8"])
    pairs = _prefixed(spark, [(text_of(), rnd.choice([1, 2, 3, 4])) for _ in range(400)], "prefix string, origin long")
    for n in (0, 3, 60):
        roas = _prefixed(spark, [(rnd.choice([1, 2, 3, None]), text_of(), rnd.choice([8, 12, 16, 24, 46, 48, None])) for _ in range(n)], "asn long, prefix string, max_length int")
        distinct = va.distinct_pairs(pairs)
        want = va.all_validity(distinct, va.best_validity(va.known_validity(distinct, roas)))
        found = va.validated_pairs(pairs, roas)
        assert found.dtypes == want.dtypes
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    # As in SQL, a pair without an origin is unknown, once.
    lone = _prefixed(spark, [("10.0.0.0/16", None)], "prefix string, origin long")
    assert [r.validity for r in va.validated_pairs(lone, _prefixed(spark, [(1, "10.0.0.0/8", 16)], "asn long, prefix string, max_length int")).collect()] == [1]


def test_the_table_of_all_invalid_pairs_reads_its_pairs_once(spark, sf):
    from pathweave.plans import registry

    plan = registry.queries()["policy_table_rov"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_empty_inputs(spark):
    pairs = spark.createDataFrame([], f"prefix {px.TYPE}, origin long")
    roas = spark.createDataFrame([], f"asn long, prefix {px.TYPE}, max_length int")
    assert va.validated_pairs(pairs, roas).count() == 0
    assert va.prefix_groups(pairs).count() == 0
    assert md.dense_id(pairs, ["origin"], "id").count() == 0
    with pytest.raises(ValueError, match="pairs"):
        va.require_rows(pairs=pairs)


def test_blocks_are_bounded_and_whole(spark, sf):
    counts = va.prefix_counts(load(spark, sf, "announcements"))
    n, size = counts.count(), 50
    blocks = md.balanced_blocks(counts, size)
    assert blocks.count() == n and blocks.select("prefix").distinct().count() == n
    per = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ann_count").alias("w")).collect()
    assert len(per) == n // size + 1 and max(r.n for r in per) <= size
    want = greedy(sorted(((r.ann_count, r.n) for r in counts.groupBy("ann_count").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True), n // size + 1, size)
    got = {(r.ann_count, r.block_id): r.n for r in blocks.groupBy("ann_count", "block_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(c, b): k for c, given in want for b, k in enumerate(given) if k}
    assert md.balanced_blocks(counts.limit(0), size).count() == 0


def greedy(histogram, n_blocks, most):
    """Each prefix into the lightest block with room, one by one."""
    heap, out = [(0, b, 0) for b in range(n_blocks)], []
    for count, n in histogram:
        given = [0] * n_blocks
        for _ in range(n):
            weight, b, k = heapq.heappop(heap)
            given[b] += 1
            if k + 1 < most:
                heapq.heappush(heap, (weight + count, b, k + 1))
        out.append((count, given))
    return out


def test_water_filling_is_the_greedy():
    rng = random.Random(4)
    for _ in range(500):
        histogram = sorted({rng.randint(0, rng.choice([5, 30, 1000])): rng.choice([1, 1, 2, 5, 40]) for _ in range(rng.randint(0, 9))}.items(), reverse=True)
        most = rng.choice([1, 2, 3, 7, 20, 100])
        n_blocks = sum(n for _, n in histogram) // most + 1
        assert [(c, g.tolist()) for c, g in md.water_filling(histogram, n_blocks, most)] == greedy(histogram, n_blocks, most)


def test_pack_groups_keeps_groups_whole(spark, sf):
    sizes = md.group_sizes(va.prefix_groups(load(spark, sf, "prefixes")))
    packed = md.pack_groups(sizes, 10)
    assert packed.count() == sizes.count()
    for limit in (1, 10, 300):
        blocks = md.pack_groups(sizes, limit).groupBy("block_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
        assert all(r.n <= limit or r.k == 1 for r in blocks) and sorted(r.block_id for r in blocks) == list(range(len(blocks)))
    made = [((4, 0, 256 * i, 24), 199) for i in range(400)]
    made = spark.createDataFrame(made, "group_prefix struct<family: tinyint, hi: bigint, lo: bigint, len: int>, n long")
    assert md.pack_groups(made, 300).groupBy("block_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] == 199
    assert packed.groupBy("group_prefix").agg(F.count_distinct("block_id").alias("k")).where("k > 1").count() == 0


def test_percent_sample(spark):
    seg = spark.createDataFrame([(i, "edge" if i % 4 else "top") for i in range(1000)], "asn long, segment string")
    for percent, want in ((0, {"edge": 1, "top": 0}), (10, {"edge": 75, "top": 24}), (100, {"edge": 749, "top": 248})):
        got = oc.percent_sample(seg, percent, exclude=4, seed=3).groupBy("segment").agg(F.sum(F.col("implement").cast("int")).alias("n"))
        assert {r.segment: r.n for r in got.collect()} == want
    again = [{r.asn for r in oc.percent_sample(df, 10, seed=3).where("implement").collect()} for df in (seg, seg.repartition(7))]
    assert again[0] == again[1]


def test_confidence_of_one_trial_is_null(spark):
    rates = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.3)], "k string, r double")
    out = {r.k: r for r in oc.mean_ci95(rates, ["k"], ["r"]).collect()}
    assert out["a"].r_ci95 is None and abs(out["b"].r_ci95 - 1.96 * 0.1414213562 / 2**0.5) < 1e-8


def test_adjacency_flags(spark):
    pc = spark.createDataFrame([(1, 2), (1, 3), (4, 3), (2, 5)], "provider_as long, customer_as long")
    peers = spark.createDataFrame([(2, 4)], "peer_as_1 long, peer_as_2 long")
    out = {r.asn: r for r in tp.as_adjacency(pc, peers).collect()}
    assert out[3].stub and out[3].multihomed and out[5].stub and not out[5].multihomed and not out[2].stub
    assert out[1].stubs == [3] and out[4].stubs == [3] and out[2].stubs == [5] and out[2].peers == [4]


def test_text_readers(spark, tmp_path):
    rib = tmp_path / "rib.txt"
    rib.write_text("=|198.51.100.0/24|64496 64501 007 64496 64511|192.0.2.77|i|||64496:5|192.0.2.77|1700000123|1\n=|1.2.4.0/24|1 {2,3}|x|i||||x|1|1\n=|bad|1 2|x|i||||x|1|1\n")
    (row,) = text.read_rib_lines(spark, str(rib)).collect()
    assert (row.as_path, row.origin, row.time) == ([64496, 64501, 7, 64496, 64511], 64511, 1700000123)
    dump = tmp_path / "dump.txt"
    dump.write_text("TABLE_DUMP2|1700000456|B|192.0.2.9|64499|203.0.112.0/23|64499 64505 64510|IGP\n")
    (row,) = text.read_dump_lines(spark, str(dump)).collect()
    assert (row.origin, row.time, row.prefix.len) == (64510, 1700000456, 23)
    day = tmp_path / "2019" / "08" / "01"
    day.mkdir(parents=True)
    (day / "roas.csv").write_text("URI,ASN,IP Prefix,Max Length,Not Before,Not After\nuri,AS64509,203.0.112.0/22,24,2015-02-03 04:05:06,2016-02-03 04:05:06\n")
    (row,) = text.read_historical_roas(spark, f"{tmp_path}/*/*/*/roas.csv").collect()
    assert (row.asn, row.maxlen, str(row.date_added), str(row.notbefore)) == (64509, 24, "2019-08-01", "2015-02-03 04:05:06")
    odd = [("u,AS1,10.0.0.0/8,x,,2015-13-45 00:00:00", "/no/day/roas.csv"), ("u,AS2,10.0.0.0/8,9,2015-02-03 04:05:06,", "/2019/13/45/roas.csv"), ("u,AS3", "/"), (None, None)]
    rows = text.parse_historical_roas(spark.createDataFrame(odd, "value string, file string")).orderBy("asn").collect()
    assert [(r.asn, r.maxlen, r.notbefore is None, r.notafter, r.date_added) for r in rows] == [(1, 8, True, None, None), (2, 9, False, None, None)]
    roas = tmp_path / "roas.json"
    roas.write_text('{"roas": [{"asn": "AS5", "prefix": "10.0.0.0/8", "maxLength": 9, "ta": "x"}]}')
    (row,) = text.read_roas_json(spark, str(roas), 77).collect()
    assert (row.asn, row.max_length, row.created_at) == (5, 9, 77)


def test_readers_pass_over_lines_that_are_too_short(spark):
    junk = ["", "|", "a", None, "=|10.0.0.0/8", "TABLE_DUMP2|1", "1|", "#", "\t", "1\tAS2", '"', "\ufffd|\x00"]
    df = spark.createDataFrame([(j, f"/2019/08/01/{i}", "cdn") for i, j in enumerate(junk)], "value string, file string, cdn string")
    for parse in (text.parse_rib_lines, text.parse_dump_lines, lambda d: text.parse_update_lines(d, 0, 900), lambda d: text.parse_relationships(d)[0], lambda d: text.parse_relationships(d)[1], text.parse_historical_roas, text.parse_probes, text.parse_validity_json, lambda d: text.parse_roas_json(d, 1), lambda d: text.extract_rank_rows(d, "value"), lambda d: text.extract_event_rows(d, "value")):
        assert parse(df).count() == 0
    assert text.parse_cdn_lines(df).count() >= 0


def test_event_rows_are_cut_inside_their_page(spark):
    """Rows of a page of 20,000 rows carry neither their page nor a join that finds its end; equal pages keep their own rows."""
    row = '<TR class="e"><td>Possible <b>Hijack</b></td><td>US</td><td>x < y</td><td>2019-08-01 00:00:01</td><td></td><td><a href="/event/{}">More</a></td></tr>'
    long = "".join(row.format(i) for i in range(20000)) + "<tr><td>broken</td></tr>" * 3
    small = row.format(7) + "<tr>" + row.format(8)
    pages = spark.createDataFrame([(1, long), (2, small), (3, small), (4, None), (5, ""), (6, "<tr><td>1</td>")], "page int, html string")
    found = text.extract_event_rows(pages, drop_last=3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.agg(F.count("*"), F.countDistinct("event_number"), F.min("event_number"), F.max("event_number")).first() == (20000, 20000, 0, 19999)
    assert sorted(r.event_number for r in text.extract_event_rows(pages.where("page > 1"), drop_last=1).collect()) == [7, 7]
    whole = text.extract_event_rows(pages.where("page > 1"), drop_last=0).collect()
    assert sorted((r.event_type, r.as_info, r.event_number) for r in whole) == [("Possible Hijack", "x < y", n) for n in (7, 7, 8, 8)]


def test_incident_details_of_a_large_page(spark):
    """Each prefix text is found once a row, and a page's rows have neither the page nor a join behind them."""
    assert str(px.parse(F.col("some_text"))).count("some_text") == 1
    cells = "<td>Possible Hijack</td><td>US</td><td>Expected Origin AS: ONE (AS 1) Detected Origin AS: TWO (AS {0})</td><td></td><td></td><td><a href='x'>/event/{0}</a></td>"
    detail = "<td>Expected prefix: {1}</td><td>x</td><td>Detected advertisement: {2}</td><td>x</td><td>Detected AS Path {0} 5</td><td>peers: {0}</td>"
    given = [("1.2.0.0/16", "1.2.3.0/24"), ("2001:db8::/32", "2001:db8:1::/48"), ("999.1.1.1/8", "no prefix")]
    page = "".join("<tr>" + (cells + detail).format(i, *given[i % 3]) + "</tr>" for i in range(9999))
    found = text.hijack_details(text.extract_event_rows(spark.createDataFrame([(page,)], "html string"), drop_last=0))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.select("detected_origin_number", px.to_text(F.col("expected_prefix")).alias("a"), px.to_text(F.col("more_specific_prefix")).alias("b"), "detected_as_path", "detected_by_bgpmon_peers").collect()
    shown = [("1.2.0.0/16", "1.2.3.0/24"), ("2001:db8:0:0:0:0:0:0/32", "2001:db8:1:0:0:0:0:0/48"), (None, None)]
    assert sorted(map(tuple, rows)) == [(i, *shown[i % 3], [i, 5], i) for i in range(9999)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.write_table(df, f"{tmp_path}/t", "overwrite")
    sinks.write_table(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    sinks.export_tsv(df, f"{tmp_path}/tsv")
    assert sorted(tuple(r) for r in text.read_stage(spark, f"{tmp_path}/tsv", "k long, v string").collect()) == [(1, "a"), (2, None)]
    sinks.promote_if_not_smaller(df, f"{tmp_path}/s")
    sinks.promote_if_not_smaller(df.unionByName(df), f"{tmp_path}/s")
    with pytest.raises(ValueError, match="2 rows"):
        sinks.promote_if_not_smaller(df, f"{tmp_path}/s")
    assert sinks.restore_if_empty(df.limit(0), f"{tmp_path}/s").count() == 4
    pairs = _prefixed(spark, [("10.0.0.0/8", 1), ("10.0.0.0/8", 1)], "prefix string, origin long")
    sinks.export_pairs_gz(pairs, f"{tmp_path}/gz")
    assert spark.read.text(f"{tmp_path}/gz").first()[0] == "1\t10.0.0.0/8\t100"


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = "=|1.2.{}.0/24|1 2|x|i|||c|x|{}|1\n"
    (src / "a.txt").write_text("".join(line.format(i, 100 * i) for i in range(5)))
    run = lambda: inc.load_new_lines(spark, str(src), text.parse_rib_lines, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    (src / "b.txt").write_text("".join(line.format(i, 100 * i) for i in range(5, 9)))
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == text.read_rib_lines(spark, str(src)).count() == 9


EVENTS = "id long, event_number long, start_time long, end_time long"


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_event_batches_rewrite_only_their_buckets(spark, tmp_path):
    path = tmp_path / "events"
    merge = inc.upsert_events(str(path), buckets=8)
    merge(spark.createDataFrame([(i, i, 1, None) for i in range(60)], EVENTS), 0)
    first = _files(path)
    assert {f.split("/")[1] for f in first} == {f"bucket={b}" for b in range(8)}
    second = spark.createDataFrame([(100, 7, 1, 9), (99, 7, 1, 5), (101, 8, 1, None), (102, 600, 3, None)], EVENTS)
    merge(second, 1)
    after = _files(path)
    assert all(after[f] == t for f, t in first.items())  # nothing that stood there is touched
    # Event 7 has changed and 600 is new; 8 says what was known, so its bucket stays.
    assert 1 <= len({f.split("/")[1] for f in after.keys() - first.keys()}) <= 2
    rows = {r.event_number: (r.id, r.end_time) for r in inc.events_table(spark, str(path)).collect()}
    assert rows == {i: (i, None) for i in range(60)} | {7: (100, 9), 600: (102, None)}
    merge(second, 1)  # again after a failure behind the commit
    assert _files(path) == after and inc.events_table(spark, str(path), [0]).count() + inc.events_table(spark, str(path), list(range(1, 8))).count() == 61
    merge(second.limit(0), 2)
    assert _files(path) == after and commits.latest(spark, str(path))[0] == 3


def test_event_batch_that_fails_before_its_commit_starts_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    merge = inc.upsert_events(path, buckets=4)
    merge(spark.createDataFrame([(1, 7, 1, None), (2, 8, 1, 5)], EVENTS), 0)
    second = spark.createDataFrame([(3, 7, 1, 9), (4, 8, 1, 5)], EVENTS)
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            merge(second, 1)
    read = lambda: {r.event_number: (r.id, r.end_time) for r in inc.events_table(spark, path).collect()}
    assert read() == {7: (1, None), 8: (2, 5)}
    merge(second, 1)
    assert read() == {7: (3, 9), 8: (2, 5)}


def test_event_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.randrange(20), rng.randrange(3), rng.choice([None, 5])) for i in range(200)]
    folder, path = tmp_path / "in", str(tmp_path / "events")
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], EVENTS).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    stream.writeStream.foreachBatch(inc.upsert_events(path, buckets=4)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.event_number: (r.start_time, r.end_time) for r in inc.events_table(spark, path).collect()}
    newest = {n: max((r for r in rows if r[1] == n)) for n in {r[1] for r in rows}}
    assert got == {n: r[2:] for n, r in newest.items()}


def test_commit_survives_a_failure_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert commits.latest(spark, path) == (0, {}) and sinks.snapshot(spark, path) is None
    sinks.promote_if_not_smaller(df, path)
    more = df.unionByName(df)
    # The writer dies when data is written but no manifest is begun.
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.promote_if_not_smaller(more, path)
    assert sinks.snapshot(spark, path).count() == 2
    # It dies with an empty manifest, with a part of one, and with one that is well formed but not marked whole.
    manifests = tmp_path / "table" / commits.MANIFESTS
    for number, text_ in ((2, ""), (3, '{"folders": ["data'), (4, '{"folders": ["none"], "rows": 9}')):
        (manifests / f"{number:010d}.json").write_text(text_)
        assert commits.latest(spark, path)[0] == 1 and sinks.snapshot(spark, path).count() == 2
    sinks.promote_if_not_smaller(more, path)
    assert commits.latest(spark, path)[0] == 5 and sinks.snapshot(spark, path).count() == 4
    # A second writer that began on the same version fails, whoever comes first.
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"folders": []}, based_on=1)
    monkeypatch.setattr(commits, "_numbers", lambda *_: [1])
    monkeypatch.setattr(commits, "latest", lambda *_: (4, {}))
    with pytest.raises(commits.Conflict, match="version 5"):
        commits.commit(spark, path, {"folders": []}, based_on=4)
    monkeypatch.undo()
    sinks.promote_if_not_smaller(more, path)
    gone = commits.expire(spark, path, keep=1)
    assert len(gone) == 2 and sinks.snapshot(spark, path).count() == 4 and commits.latest(spark, path)[0] == 6


def test_served_tables(spark, tmp_path):
    path, rows = str(tmp_path / "served"), [(i % 40 if i % 3 else 7, i) for i in range(900)] + [(None, -1), (-3, -2)]
    df = spark.createDataFrame(rows, "asn long, v long")
    with pytest.raises(FileNotFoundError):
        serving.lookup(spark, path, [1])
    serving.publish(df, path, "asn", buckets=16)
    found = serving.lookup(spark, path, [7, 23, 1000, -3])
    assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[0] in (7, 23, -3))
    # 7 and 23 lie in bucket 7, -3 in 13, and 1000 would in 8; no other folder is read.
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == {"7", "8", "13"}
    assert serving.lookup(spark, path).count() == 902 and serving.lookup(spark, path, []).count() == 0 and serving.lookup(spark, path, [1001]).count() == 0
    serving.publish(df.limit(0), path, "asn")
    assert serving.lookup(spark, path, [7]).count() == 0 and serving.lookup(spark, path).count() == 0


def test_served_tables_are_renewed_when_inputs_change(spark, tmp_path):
    source, path, built = str(tmp_path / "in"), str(tmp_path / "served"), []
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    state = lambda: serving.fingerprint(spark, {"in": [source]})
    assert serving.refresh(spark, path, build, state(), "id") and not serving.refresh(spark, path, build, state(), "id")
    spark.range(5, 9).write.mode("append").parquet(source)
    assert serving.refresh(spark, path, build, state(), "id") and len(built) == 2
    assert sorted(r.id for r in serving.lookup(spark, path).collect()) == list(range(9))


def test_interval_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(1_700_000_000 + rng.randrange(4000), rng.choice("AWB"), k) for k in range(300)]
    # Nearly in order: nothing comes more than 500 seconds behind the newest, and a third of the rows comes twice.
    order = sorted(rows + rng.sample(rows, 100), key=lambda r: r[0] + rng.randrange(500))
    schema, folder = "time long, update_type string, seq long", tmp_path / "in"

    def put(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").json(str(folder))

    for k in range(0, len(order), 100):
        put(order[k : k + 100])
    # The end of all intervals; then a row of the first one, far behind, twice, a new one that comes in time, and rows without a time or type.
    put([(1_700_100_000, "W", -1)])
    put([(1_700_000_001, "A", -2), (1_700_000_001, "A", -2), (1_700_000_003, "A", -3), (1_700_100_010, "W", -4), (None, "A", 1), (1_700_100_000, None, 1)])
    put([rows[0], (1_700_200_000, "W", -5)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    out = inc.closed_intervals(stream, 900, late_seconds=600, horizon_seconds=10**6)
    # Run in two parts, as after a restart.
    for _ in range(2):
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    batch = inc.closed_intervals(spark.createDataFrame([*order, (1_700_100_000, "W", -1), (1_700_100_010, "W", -4), (None, "A", 1)], schema), 900)
    assert sorted(r for r in found if r[3] == "interval") == sorted(tuple(r) for r in batch.collect())
    first = 1_700_000_001 - 1_700_000_001 % 900
    assert [r for r in found if r[3] == "late"] == [(first, first + 900, "A", "late", 2)]
