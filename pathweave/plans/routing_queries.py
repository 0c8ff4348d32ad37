"""Queries on announcements, validation, metadata and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.operators import metadata as md
from pathweave.operators import monitors as mo
from pathweave.operators import topology as tp
from pathweave.operators import validation as va
from pathweave.plans.views import flat, load, oracle

_P = "cast(power(2, 32 - {0}) as bigint)"
_IN = "{a}.len >= {b}.len and {a}.net >= {b}.net and {a}.net < {b}.net + cast(power(2, 32 - {b}.len) as bigint)"
_STRICT = _IN.replace(">= {b}.len", "> {b}.len", 1)


def _inside(a, b):
    return _IN.format(a=a, b=b)


def _strictly(a, b):
    return _STRICT.format(a=a, b=b)


def _q(run, sql=None):
    return run, sql


def _pc(s, d):
    return load(s, d, "provider_customers"), load(s, d, "peers")


def _ann(s, d):
    return load(s, d, "announcements")


def _validity(s, d):
    return va.validated_pairs(_ann(s, d), load(s, d, "roas"))


def _groups(s, d):
    return va.prefix_groups(load(s, d, "prefixes"))


_DUAL_IN = (
    "{a}.family = {b}.family and {a}.len >= {b}.len and case when {b}.family = 4 then {a}.net - {b}.net between 0 and cast(power(2, 32 - {b}.len) as bigint) - 1"
    " when {b}.len <= 64 then {a}.hi >= {b}.hi and {a}.hi - {b}.hi < power(2, 64 - {b}.len) else {a}.hi = {b}.hi and {a}.net >= {b}.net and {a}.net - {b}.net < power(2, 128 - {b}.len) end"
)


def _dual_in(a, b, strict=False):
    return _DUAL_IN.replace(">= {b}.len", "> {b}.len" if strict else ">= {b}.len", 1).format(a=a, b=b)


_DUAL_TOPS = {"tops": "select family, hi, net, len from dual_prefixes p where not exists (select 1 from dual_prefixes q where " + _dual_in("p", "q", True) + ")"}


def _hosts(s, d):
    """Addresses of both families that lie in or beside the announced prefixes."""
    p = F.col("prefix")
    lo = F.when(p["family"] == 4, p["lo"] + 5).otherwise(p["lo"])
    return load(s, d, "dual_prefixes").select(px.make(p["family"], p["hi"], lo, F.when(p["family"] == 4, 32).otherwise(128)).alias("prefix"))


_HOSTS = {"hosts": "select family, hi, case when family = 4 then net + 5 else net end as net, case when family = 4 then 32 else 128 end as len from dual_prefixes"}
_TOPS = "select p.net, p.len from prefixes p where not exists (select 1 from prefixes q where " + _strictly("p", "q") + ")"
_GROUPS = "select p.net, p.len, t.net as group_net, t.len as group_len from prefixes p join tops t on " + _inside("p", "t")


def _metadata(s, d, size=60):
    """Pairs with ids, block, validity and block-local ids."""
    ann = _ann(s, d)
    pairs = va.distinct_pairs(ann)
    prefix_ids = md.dense_id(ann.select("prefix").distinct(), [px.order_key(F.col("prefix"))], "prefix_id")
    origin_ids = md.dense_id(ann.select("origin").distinct(), ["origin"], "origin_id")
    with_ids = md.attach_ids(md.dense_id(pairs, [px.order_key(F.col("prefix")), "origin"], "prefix_origin_id"), prefix_ids, origin_ids)
    blocks = md.balanced_blocks(va.prefix_counts(ann), size)
    return md.attach_block_ids(md.attach_blocks(with_ids, blocks, _validity(s, d)))


def _even_links(s, d):
    return tp.links(*_pc(s, d)).where("a % 2 = 0")


_EVEN = "select unnest([a, b]) from (select peer_as_1 as a, peer_as_2 as b from peers union select provider_as, customer_as from provider_customers) l where a % 2 = 0"

_IDS = {
    "pid": "select net, len, row_number() over (order by net, len) - 1 as prefix_id from (select distinct net, len from announcements) x",
    "oid": "select origin, row_number() over (order by origin) - 1 as origin_id from (select distinct origin from announcements) x",
    "poid": "select net, len, origin, row_number() over (order by net, len, origin) - 1 as prefix_origin_id from pairs",
}

#: The greedy itself, a prefix a step: the lightest block with room gets the next one in falling order of count.
_GREEDY = {
    "ranked": "select net, len, ann_count, row_number() over (order by ann_count desc, net, len) as i, row_number() over (partition by ann_count order by net, len) as nth from (select net, len, count(*) as ann_count from announcements group by net, len) x",
    "blocks": "select count(*) // 60 + 1 as n from ranked",
    "steps": "select 0::bigint as i, 0::bigint as c, 0 as block, list_transform(range(n), lambda x: 0::bigint) as w, list_transform(range(n), lambda x: 0::bigint) as k from blocks"
    " union all select i, c, slot - 1, list_transform(w, lambda x, j: case when j = slot then x + c else x end), list_transform(k, lambda x, j: case when j = slot then x + 1 else x end)"
    " from (select r.i, r.ann_count as c, s.w, s.k, list_position(list_transform(s.w, lambda x, j: case when s.k[j] < 60 then x end), list_min(list_transform(s.w, lambda x, j: case when s.k[j] < 60 then x end))) as slot from steps s join ranked r on r.i = s.i + 1) y",
    "dealt": "select c, block, count(*) as m from steps where i > 0 group by c, block",
    "spans": "select c, block, m, sum(m) over (partition by c order by m desc, block) - m as low from dealt",
}

_BLOCKED = "select p.net, p.len, p.ann_count, b.block as block_id from ranked p join spans b on b.c = p.ann_count and p.nth - 1 >= b.low and p.nth - 1 < b.low + b.m"
_PATHS = (
    "select suppkey as monitor_asn, orderkey as prefix_id, [suppkey, p % 9, suppkey % 40] as truth, case ln % 3 when 1 then [suppkey, p % 7, suppkey % 40] when 2 then [suppkey, p % 7, p % 5, suppkey % 40] end as guess"
    " from (select l_suppkey as suppkey, l_orderkey as orderkey, max(l_partkey) as p, max(l_linenumber) as ln from lineitem group by l_suppkey, l_orderkey) q"
)
#: The test database compares bytes, so each value is a letter by its first place in both paths.
_TEXT = "array_to_string(list_transform({0}, lambda v: chr((64 + list_position(list_concat(truth, guess), v))::int)), '')"
_DISTANCE = f"coalesce(case when guess is not null then levenshtein({_TEXT.format('truth')}, {_TEXT.format('guess')}) end, 3)::int"

QUERIES = {
    # Both families
    "dual_filter_family_4": _q(lambda s, d: flat(va.filter_family(load(s, d, "dual")), whole=True), oracle("select family, hi, net, len, origin from dual where family = 4", "dual")),
    "dual_filter_family_6": _q(lambda s, d: flat(va.filter_family(load(s, d, "dual"), ipv4=False, ipv6=True), whole=True), oracle("select family, hi, net, len, origin from dual where family = 6", "dual")),
    "dual_sorted": _q(lambda s, d: flat(va.sort_by_prefix(load(s, d, "dual_prefixes")), whole=True), oracle("select family, hi, net, len from dual_prefixes", "dual_prefixes")),
    "dual_covering_join": _q(
        lambda s, d: flat(va.covering_join(load(s, d, "dual"), load(s, d, "dual_roas")), whole=True),
        oracle("select p.family, p.hi, p.net, p.len, p.origin, r.asn, r.max_length, r.family as roa_family, r.hi as roa_hi, r.net as roa_net, r.len as roa_len from dual p join dual_roas r on " + _dual_in("p", "r"), "dual", "dual_roas")),
    "dual_validity": _q(
        lambda s, d: flat(va.validated_pairs(load(s, d, "dual"), load(s, d, "dual_roas")), whole=True).withColumn("validity", F.col("validity").cast("int")),
        oracle("select p.family, p.hi, p.net, p.len, p.origin, coalesce(min(case when p.origin <> r.asn and p.len > r.max_length then 4 when p.origin <> r.asn then 3 when p.len > r.max_length then 2 when r.asn is not null then 0 end), 1) as validity from dual p left join dual_roas r on " + _dual_in("p", "r") + " group by p.family, p.hi, p.net, p.len, p.origin", "dual", "dual_roas")),
    "dual_top_level_prefixes": _q(lambda s, d: flat(va.top_level_prefixes(load(s, d, "dual_prefixes")), whole=True), oracle("select * from tops", "dual_prefixes", extra=_DUAL_TOPS)),
    "dual_prefix_groups": _q(
        lambda s, d: flat(va.prefix_groups(load(s, d, "dual_prefixes")), whole=True),
        oracle("select p.family, p.hi, p.net, p.len, t.family as group_family, t.hi as group_hi, t.net as group_net, t.len as group_len from dual_prefixes p join tops t on " + _dual_in("p", "t"), "dual_prefixes", extra=_DUAL_TOPS)),
    "dual_most_specific_per_as": _q(
        lambda s, d: flat(va.most_specific_per_as(load(s, d, "dual").withColumnRenamed("origin", "asn")), whole=True),
        oracle("select a.origin as asn, a.family, a.hi, a.net, a.len from dual a where not exists (select 1 from dual b where b.origin = a.origin and " + _dual_in("b", "a", True) + ")", "dual")),
    "dual_longest_prefix_match": _q(
        lambda s, d: flat(va.longest_prefix_match(_hosts(s, d), load(s, d, "dual_roas").select("prefix", F.col("asn").alias("origin"))), whole=True),
        oracle("select h.family, h.hi, h.net, h.len, x.origin from hosts h left join (select family, hi, net, len, origin from (select i.*, r.asn as origin, row_number() over (partition by i.family, i.hi, i.net order by r.len desc, r.asn) as n from (select distinct * from hosts) i join dual_roas r on " + _dual_in("i", "r") + ") y where n = 1) x on x.family = h.family and x.hi = h.hi and x.net = h.net and x.len = h.len", "dual_prefixes", "dual_roas", extra=_HOSTS)),
    # IPv4
    "validity_counts": _q(
        lambda s, d: _validity(s, d).groupBy(F.col("validity").cast("int").alias("validity")).agg(F.count(F.lit(1)).alias("n")),
        oracle("select validity, count(*) as n from validity group by validity", "validity")),
    "covering_join": _q(lambda s, d: flat(va.covering_join(va.distinct_pairs(_ann(s, d)), load(s, d, "roas"))), oracle("select net, len, origin, asn, max_length, roa_net, roa_len from codes", "codes")),
    "covered_announcements": _q(lambda s, d: flat(va.covered_announcements(_ann(s, d), load(s, d, "roas"), ("prefix", "monitor_asn", "origin"))), oracle("select a.net, a.len, monitor_asn, origin, min(a.time) as time from announcements a where exists (select 1 from roas r where " + _inside("a", "r") + ") group by a.net, a.len, monitor_asn, origin", "announcements", "roas")),
    "roa_codes": _q(lambda s, d: flat(va.known_validity(va.distinct_pairs(_ann(s, d)), load(s, d, "roas"))).withColumn("validity", F.col("validity").cast("int")), oracle("select net, len, origin, validity from codes", "codes")),
    "best_validity": _q(lambda s, d: flat(va.best_validity(va.known_validity(va.distinct_pairs(_ann(s, d)), load(s, d, "roas")))).withColumn("validity", F.col("validity").cast("int")), oracle("select net, len, origin, validity from known", "known")),
    "worst_validity": _q(lambda s, d: (lambda p: flat(va.worst_validity(p, va.known_validity(p, load(s, d, "roas")))).withColumn("validity", F.col("validity").cast("int")))(va.distinct_pairs(_ann(s, d))), oracle("select p.net, p.len, p.origin, coalesce(w, 1) as validity from pairs p left join (select net, len, origin, case when min(validity) = 0 then 0 else max(validity) end as w from codes group by net, len, origin) x on p.net = x.net and p.len = x.len and p.origin = x.origin", "pairs", "codes")),
    "all_validity": _q(lambda s, d: flat(_validity(s, d)).withColumn("validity", F.col("validity").cast("int")), oracle("select net, len, origin, validity from validity", "validity")),
    "filter_family": _q(lambda s, d: flat(va.filter_family(_ann(s, d), ipv4=True, ipv6=False)), oracle("select net, len, origin, monitor_asn, time from announcements", "announcements")),
    "masklen": _q(lambda s, d: _ann(s, d).groupBy(px.masklen(F.col("prefix")).alias("len")).agg(F.count(F.lit(1)).alias("n")), oracle("select len, count(*) as n from announcements group by len", "announcements")),
    "covered_by": _q(lambda s, d: (lambda p: flat(p.where(px.covered_by(F.col("prefix"), px.make(4, 0, 16777216, 8)))))(va.distinct_pairs(_ann(s, d))), oracle("select net, len, origin from pairs where len >= 8 and net >= 16777216 and net < 33554432", "pairs")),
    "strictly_covered_by": _q(lambda s, d: (lambda p: flat(p.where(px.strictly_covered_by(F.col("prefix"), px.make(4, 0, 16777216, 8)))))(va.distinct_pairs(_ann(s, d))), oracle("select net, len, origin from pairs where len > 8 and net >= 16777216 and net < 33554432", "pairs")),
    "monitor_asn": _q(lambda s, d: _ann(s, d).select(va.monitor_asn(F.array("monitor_asn", "origin")).alias("monitor_asn")).groupBy("monitor_asn").agg(F.count(F.lit(1)).alias("n")), oracle("select monitor_asn, count(*) as n from announcements group by monitor_asn", "announcements")),
    "latest_snapshot": _q(lambda s, d: flat(va.latest_snapshot(_ann(s, d).withColumn("created_at", F.col("time") % 50))).drop("created_at"), oracle("select net, len, origin, monitor_asn, time from announcements where time % 50 = (select max(time % 50) from announcements)", "announcements")),
    "only_prefix": _q(lambda s, d: flat(va.only_prefix(_ann(s, d), px.make(4, 0, 16777216, 8))), oracle("select net, len, origin, monitor_asn, time from announcements where net = 16777216 and len = 8", "announcements")),
    "unique_prefix_origins": _q(lambda s, d: flat(va.unique_prefix_origins(_ann(s, d))), oracle("select net, len, origin, 100 as placeholder from pairs", "pairs")),
    "sort_by_prefix": _q(lambda s, d: flat(va.sort_by_prefix(va.distinct_pairs(_ann(s, d)))), oracle("select net, len, origin from pairs order by net, len", "pairs")),
    "distinct_pairs": _q(lambda s, d: flat(va.distinct_pairs(_ann(s, d))), oracle("select net, len, origin from pairs", "pairs")),
    "prefix_counts": _q(lambda s, d: flat(va.prefix_counts(_ann(s, d))), oracle("select net, len, count(*) as ann_count from announcements group by net, len", "announcements")),
    "top_level_prefixes": _q(lambda s, d: flat(va.top_level_prefixes(load(s, d, "prefixes"))), oracle(_TOPS, "prefixes")),
    "non_top_prefixes": _q(lambda s, d: (lambda p: flat(va.non_top_prefixes(p, va.top_level_prefixes(p))))(load(s, d, "prefixes")), oracle("select net, len from prefixes except select net, len from tops", "prefixes", extra={"tops": _TOPS})),
    "prefix_groups": _q(lambda s, d: flat(_groups(s, d)), oracle(_GROUPS, "prefixes", extra={"tops": _TOPS})),
    "group_sizes": _q(lambda s, d: flat(md.group_sizes(_groups(s, d))), oracle("select group_net, group_len, count(*) as n from g group by group_net, group_len", "prefixes", extra={"tops": _TOPS, "g": _GROUPS})),
    "pack_groups": _q(
        lambda s, d: flat(md.pack_groups(md.group_sizes(_groups(s, d)), 300)),
        oracle("select group_net, group_len, n, block_id from (select *, sum(case when (place - low) % fit = 0 then 1 else 0 end) over (order by place) - 1 as block_id from (select *, min(place) over (partition by fit) as low from (select *, row_number() over (order by fit, n desc, group_net, group_len) - 1 as place from (select group_net, group_len, count(*) as n, greatest(1, 300 // count(*)) as fit from g group by group_net, group_len) a) b) c) d", "prefixes", extra={"tops": _TOPS, "g": _GROUPS})),
    "most_specific_per_as": _q(lambda s, d: flat(va.most_specific_per_as(_ann(s, d).select(F.col("origin").alias("asn"), "prefix").distinct())), oracle("select a.origin as asn, a.net, a.len from pairs a where not exists (select 1 from pairs b where b.origin = a.origin and " + _strictly("b", "a") + ")", "pairs")),
    "best_historical_roa": _q(
        lambda s, d: flat(va.best_historical_roa(load(s, d, "prefixes"), load(s, d, "roas").select("asn", "prefix", F.col("max_length").alias("maxlen"), (F.col("asn") % 7).alias("notafter")))),
        oracle("select net, len, asn, maxlen, notafter, roa_net, roa_len, addresses from (select p.net, p.len, r.asn, r.max_length as maxlen, r.asn % 7 as notafter, r.net as roa_net, r.len as roa_len, power(2.0, 32 - p.len) as addresses, row_number() over (partition by p.net, p.len order by r.asn % 7 desc, r.len desc, r.asn, r.max_length) as n from prefixes p join roas r on " + _inside("p", "r") + ") x where n = 1", "prefixes", "roas")),
    "earliest_roa": _q(lambda s, d: flat(va.earliest_roa(_ann(s, d).select("prefix", "origin", F.col("time").alias("date_added")))), oracle("select net, len, origin, min(time) as date_added from announcements group by net, len, origin", "announcements")),
    "longest_prefix_match": _q(
        lambda s, d: flat(va.longest_prefix_match(load(s, d, "hijack_events").select(px.make(4, 0, F.col("prefix.lo") + 5, 32).alias("prefix")).distinct(), va.distinct_pairs(_ann(s, d)))),
        oracle("select net, len, origin from (select i.net, i.len, p.origin, row_number() over (partition by i.net order by p.len desc, p.origin) as n from (select distinct net + 5 as net, 32 as len from hijack_events) i left join pairs p on " + _inside("i", "p") + ") x where n = 1", "hijack_events", "pairs")),
    "collapsed_paths": _q(
        lambda s, d: va.collapsed_paths(_ann(s, d).select("time", "monitor_asn", F.when(F.col("origin") > 3, F.col("origin") % 5).alias("origin")), ["time"], "monitor_asn").select("time", F.array_join("path", ",").alias("path")),
        oracle("select time, string_agg(cast(o as varchar), ',' order by monitor_asn, o) as path from (select time, monitor_asn, o, lag(o) over (partition by time order by monitor_asn, o) as before from (select time, monitor_asn, case when origin > 3 then origin % 5 end as o from announcements) x where o is not null) y where before is null or before <> o group by time", "announcements")),
    "as_geo": _q(
        lambda s, d: flat(va.as_geo(_ann(s, d).select(F.col("origin").alias("asn")), va.distinct_pairs(_ann(s, d)), load(s, d, "roas").groupBy("prefix").agg(F.min("asn").alias("country")))),
        oracle("select asn, net, len, block_net, block_len, country from (select p.origin as asn, p.net, p.len, r.net as block_net, r.len as block_len, r.country, row_number() over (partition by p.origin order by r.len desc) as n from (select origin, net, len, row_number() over (partition by origin order by net, len) as k from pairs) p join (select net, len, min(asn) as country from roas group by net, len) r on p.k = 1 and " + _inside("p", "r") + ") x where n = 1", "pairs", "roas")),
    "dense_id": _q(lambda s, d: flat(md.dense_id(va.distinct_pairs(_ann(s, d)), [px.order_key(F.col("prefix")), "origin"], "prefix_origin_id")), oracle("select net, len, origin, prefix_origin_id from poid", "pairs", extra={"poid": _IDS["poid"]})),
    "attach_ids": _q(
        lambda s, d: flat(md.attach_ids(va.distinct_pairs(_ann(s, d)), md.dense_id(_ann(s, d).select("prefix").distinct(), [px.order_key(F.col("prefix"))], "prefix_id"), md.dense_id(_ann(s, d).select("origin").distinct(), ["origin"], "origin_id"))),
        oracle("select p.net, p.len, p.origin, prefix_id, origin_id from pairs p join pid on p.net = pid.net and p.len = pid.len join oid on p.origin = oid.origin", "pairs", extra={k: _IDS[k] for k in ("pid", "oid")})),
    "balanced_blocks": _q(
        lambda s, d: flat(md.balanced_blocks(va.prefix_counts(_ann(s, d)), 60)),
        oracle("select * from blocked", "announcements", extra=_GREEDY | {"blocked": _BLOCKED}).replace("with ", "with recursive ", 1)),
    "block_weights": _q(
        lambda s, d: md.balanced_blocks(va.prefix_counts(_ann(s, d)), 60).groupBy("block_id").agg(F.sum("ann_count").alias("announcements"), F.count(F.lit(1)).alias("prefixes")),
        oracle("select block as block_id, sum(c * m)::bigint as announcements, sum(m)::bigint as prefixes from dealt group by block", "announcements", extra=_GREEDY).replace("with ", "with recursive ", 1)),
    "block_prefix_id": _q(
        lambda s, d: flat(md.block_prefix_id(va.distinct_pairs(_ann(s, d)).withColumn("block_id", F.col("prefix.len")))),
        oracle("select net, len, len as block_id, dense_rank() over (partition by len order by net) - 1 as block_prefix_id from (select distinct net, len from pairs) x", "pairs")),
    "attach_blocks": _q(
        lambda s, d: flat(md.attach_blocks(va.distinct_pairs(_ann(s, d)), va.prefix_counts(_ann(s, d)).select("prefix", F.col("prefix.len").alias("block_id")), _validity(s, d))).withColumn("validity", F.col("validity").cast("int")),
        oracle("select net, len, origin, len as block_id, validity from validity", "validity")),
    "attach_block_ids": _q(
        lambda s, d: flat(md.attach_block_ids(va.distinct_pairs(_ann(s, d)).withColumn("block_id", F.col("prefix.len")))),
        oracle("select net, len, origin, len as block_id, dense_rank() over (partition by len order by net) - 1 as block_prefix_id from pairs", "pairs")),
    "announcements_with_metadata": _q(lambda s, d: flat(md.announcements_with_metadata(_ann(s, d), _metadata(s, d))).withColumn("validity", F.col("validity").cast("int")).withColumn("block_prefix_id", F.col("block_prefix_id").cast("int")),
        oracle("select a.net, a.len, a.origin, a.monitor_asn, a.time, prefix_origin_id, prefix_id, origin_id, validity, block_id, block_prefix_id, cast(null as bigint) as origin_hijack_asn from announcements a join poid on a.net = poid.net and a.len = poid.len and a.origin = poid.origin join pid on a.net = pid.net and a.len = pid.len join oid on a.origin = oid.origin join validity v on a.net = v.net and a.len = v.len and a.origin = v.origin join (select net, len, block_id, (row_number() over (partition by block_id order by net, len) - 1)::int as block_prefix_id from blocked) b on a.net = b.net and a.len = b.len", "announcements", "validity", extra=_IDS | _GREEDY | {"blocked": _BLOCKED}).replace("with ", "with recursive ", 1)),
    "block_sample": _q(lambda s, d: flat(mo.block_sample(va.distinct_pairs(_ann(s, d)).withColumn("block_id", F.col("prefix.len")), 12)), oracle("select net, len, origin, len as block_id from pairs where len <= 12", "pairs")),
    "distinct_on": _q(lambda s, d: flat(md.distinct_on(_ann(s, d), ["prefix", "origin"], [F.col("time"), F.col("monitor_asn")])), oracle("select net, len, origin, monitor_asn, time from (select *, row_number() over (partition by net, len, origin order by time, monitor_asn) as n from announcements) x where n = 1", "announcements")),
    "first_per_key": _q(lambda s, d: flat(va.first_per_key(_ann(s, d), ["monitor_asn"], [F.col("time").desc(), F.col("origin"), px.order_key(F.col("prefix"))])), oracle("select net, len, origin, monitor_asn, time from (select *, row_number() over (partition by monitor_asn order by time desc, origin, net, len) as n from announcements) x where n = 1", "announcements")),
    "last_per_key": _q(lambda s, d: md.last_per_key(load(s, d, "hijack_events").select(F.pmod("event_number", F.lit(97)).alias("k"), "event_number", "origin"), ["k"], "event_number"), oracle("select event_number % 97 as k, max(event_number) as event_number, max_by(origin, event_number) as origin from hijack_events group by event_number % 97", "hijack_events")),
    # Topology
    "all_ases": _q(lambda s, d: tp.all_ases(*_pc(s, d)), oracle("select asn from ases", "ases")),
    "edge_endpoints": _q(lambda s, d: tp.edge_endpoints(*_pc(s, d)), oracle("select provider_as as asn from provider_customers union all select customer_as from provider_customers union all select peer_as_1 from peers union all select peer_as_2 from peers", "provider_customers", "peers")),
    "count_ases": _q(lambda s, d: tp.count_ases(*_pc(s, d)), oracle("select count(*) as total_ases from ases", "ases")),
    "connectivity": _q(lambda s, d: tp.connectivity(*_pc(s, d)), oracle("select asn, cast(connectivity as bigint) as connectivity from conn", "conn")),
    "as_adjacency": _q(
        lambda s, d: tp.as_adjacency(*_pc(s, d)).select("asn", *[F.array_join(c, ",").alias(c) for c in ("peers", "customers", "providers", "stubs")], "stub", "multihomed"),
        oracle("""select a.asn, coalesce((select string_agg(cast(x as varchar), ',' order by x) from (select peer_as_2 as x from peers p where p.peer_as_1 = a.asn union select peer_as_1 from peers p where p.peer_as_2 = a.asn) q), '') as peers,
  coalesce(c.l, '') as customers, coalesce(r.l, '') as providers, coalesce(st.l, '') as stubs,
  c.n is null and not exists (select 1 from peers p where p.peer_as_1 = a.asn or p.peer_as_2 = a.asn) as stub,
  c.n is null and not exists (select 1 from peers p where p.peer_as_1 = a.asn or p.peer_as_2 = a.asn) and coalesce(r.n, 0) > 1 as multihomed
from ases a left join (select provider_as, count(*) as n, string_agg(cast(customer_as as varchar), ',' order by customer_as) as l from provider_customers group by provider_as) c on c.provider_as = a.asn
left join (select customer_as, count(*) as n, string_agg(cast(provider_as as varchar), ',' order by provider_as) as l from provider_customers group by customer_as) r on r.customer_as = a.asn
left join (select provider_as, string_agg(cast(customer_as as varchar), ',' order by customer_as) as l from provider_customers where customer_as not in (select peer_as_1 from peers union select peer_as_2 from peers union select provider_as from provider_customers) group by provider_as) st on st.provider_as = a.asn""", "ases")),
    "stub_flags": _q(lambda s, d: tp.stub_flags(*_pc(s, d)), oracle("select asn, b as stub, b and n > 1 as multihomed from (select a.asn, a.asn not in (select provider_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers) as b, (select count(*) from provider_customers c where c.customer_as = a.asn) as n from ases a) x", "ases")),
    "edge_as_count": _q(lambda s, d: tp.edge_as_count(*_pc(s, d)), oracle("select count(*) as edge_ases from (select asn from e where asn not in (select provider_as from provider_customers) group by asn having count(*) = 1) x", "provider_customers", "peers", extra={"e": "select provider_as as asn from provider_customers union all select customer_as from provider_customers union all select peer_as_1 from peers union all select peer_as_2 from peers"})),
    "multihomed_count": _q(lambda s, d: tp.multihomed_count(*_pc(s, d)), oracle("select count(*) as multihomed_ases from (select customer_as from provider_customers where customer_as not in (select provider_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers) group by customer_as having count(distinct provider_as) > 1) x", "provider_customers", "peers")),
    "peer_only_count": _q(lambda s, d: tp.peer_only_count(*_pc(s, d)), oracle("select count(*) as peer_only_ases from (select asn from (select peer_as_1 as asn from peers union all select peer_as_2 from peers) p where asn not in (select provider_as from provider_customers union select customer_as from provider_customers) group by asn having count(*) > 1) x", "provider_customers", "peers")),
    "topology_summary": _q(lambda s, d: tp.topology_summary(*_pc(s, d)), oracle("""select metric, cast(value as bigint) as value from (select 'total_ases' as metric, t as value from n union all select 'edge_ases', e from n union all select 'multihomed_ases', m from n union all select 'peer_only_ases', p from n union all select 'customer_links', (select count(*) from provider_customers) from n union all select 'peer_links', (select count(*) from peers) from n union all select 'transit_ases', t - e - m from n) x""", "ases", extra={
        "e": "select provider_as as asn from provider_customers union all select customer_as from provider_customers union all select peer_as_1 from peers union all select peer_as_2 from peers",
        "n": "select (select count(*) from ases) as t, (select count(*) from (select asn from e where asn not in (select provider_as from provider_customers) group by asn having count(*) = 1) x) as e, (select count(*) from (select customer_as from provider_customers where customer_as not in (select provider_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers) group by customer_as having count(distinct provider_as) > 1) x) as m, (select count(*) from (select asn from (select peer_as_1 as asn from peers union all select peer_as_2 from peers) p where asn not in (select provider_as from provider_customers union select customer_as from provider_customers) group by asn having count(*) > 1) x) as p"})),
    "links": _q(lambda s, d: tp.links(*_pc(s, d)), oracle("select peer_as_1 as a, peer_as_2 as b from peers union select provider_as, customer_as from provider_customers", "provider_customers", "peers")),
    "neighbours": _q(lambda s, d: tp.neighbours(*_pc(s, d), load(s, d, "as_rank").where("asn % 3 = 0")), oracle("select distinct asn, neighbour, kind from (select peer_as_1 as asn, peer_as_2 as neighbour, 'peer' as kind from peers union all select peer_as_2, peer_as_1, 'peer' from peers union all select provider_as, customer_as, 'customer' from provider_customers union all select customer_as, provider_as, 'provider' from provider_customers) x where asn % 3 = 0 and asn in (select asn from as_rank)", "provider_customers", "peers", "as_rank")),
    "stubs_to_parents": _q(lambda s, d: tp.stubs_to_parents(load(s, d, "as_rank"), tp.stub_parents(*_pc(s, d))), oracle("select as_rank, coalesce(p.parent, r.asn) as asn from as_rank r left join (select customer_as, min(provider_as) as parent from provider_customers where customer_as not in (select provider_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers) group by customer_as) p on p.customer_as = r.asn", "as_rank", "provider_customers", "peers")),
    "as_segments": _q(lambda s, d: tp.as_segments(tp.all_ases(*_pc(s, d)), load(s, d, "as_rank"), tp.connectivity(*_pc(s, d)), 800), oracle("select a.asn, case when as_rank <= 800 then 'top' when connectivity = 0 then 'edge' else 'etc' end as segment from ases a left join as_rank r on a.asn = r.asn left join conn c on a.asn = c.asn", "ases", "as_rank", "conn")),
    "seed_as": _q(lambda s, d: tp.seed_as(tp.connectivity(*_pc(s, d)), 80), oracle("select asn, cast(connectivity as bigint) as connectivity from conn where connectivity < 80 order by connectivity desc, asn limit 1", "conn")),
    "k_hop": _q(lambda s, d: tp.k_hop(tp.links(*_pc(s, d)), 5, 2), oracle("select asn, cast(min(level) as int) as level from (select 5 as asn, 0 as level union all select y, 1 from b where x = 5 union all select b2.y, 2 from b b1 join b b2 on b1.x = 5 and b1.y = b2.x) q group by asn", "provider_customers", "peers", extra={"b": "select peer_as_1 as x, peer_as_2 as y from peers union select peer_as_2, peer_as_1 from peers union select provider_as, customer_as from provider_customers union select customer_as, provider_as from provider_customers"})),
    "restrict_to_links": _q(lambda s, d: tp.restrict_to_links(load(s, d, "provider_customers"), tp.links(*_pc(s, d)).where("a % 2 = 0"), "provider_as", "customer_as"), oracle("select provider_as, customer_as from provider_customers where provider_as % 2 = 0", "provider_customers")),
    "restrict_to_linked": _q(lambda s, d: tp.restrict_to_linked(load(s, d, "as_rank"), _even_links(s, d)), oracle("select as_rank, asn from as_rank where asn in (" + _EVEN + ")", "as_rank", "provider_customers", "peers")),
    "unlinked": _q(lambda s, d: tp.unlinked(load(s, d, "conn"), _even_links(s, d)).withColumn("connectivity", F.col("connectivity").cast("long")), oracle("select asn, connectivity::bigint as connectivity from conn where asn not in (" + _EVEN + ")", "conn")),
    "top_ases": _q(lambda s, d: tp.top_ases(load(s, d, "as_rank"), 100), oracle("select as_rank, asn from as_rank order by as_rank limit 100", "as_rank")),
    "rank_window": _q(lambda s, d: tp.rank_window(load(s, d, "as_rank"), 200, 900), oracle("select as_rank, asn from as_rank where as_rank between 200 and 900", "as_rank")),
    # Monitors
    "monitor_counts": _q(lambda s, d: mo.monitor_counts(_ann(s, d)), oracle("select monitor_asn, count(distinct net * 64 + len) as distinct_prefixes, count(*) as total_ann from announcements group by monitor_asn", "announcements")),
    "monitor_stats": _q(lambda s, d: mo.monitor_stats(_ann(s, d), load(s, d, "as_rank")), oracle("select monitor_asn, distinct_prefixes, total_ann, coalesce(as_rank, (select count(*) + 1 from as_rank)) as as_rank, total_ann - distinct_prefixes as extra_ann from (select monitor_asn, count(distinct net * 64 + len) as distinct_prefixes, count(*) as total_ann from announcements group by monitor_asn) m left join as_rank r on m.monitor_asn = r.asn", "announcements", "as_rank")),
    "with_rank": _q(lambda s, d: mo.with_rank(mo.monitor_counts(_ann(s, d)).select("monitor_asn"), load(s, d, "as_rank").where("asn % 2 = 0")), oracle("select monitor_asn, coalesce(as_rank, (select count(*) + 1 from as_rank where asn % 2 = 0)) as as_rank from (select distinct monitor_asn from announcements) m left join as_rank r on m.monitor_asn = r.asn and r.asn % 2 = 0", "announcements", "as_rank")),
    "control_monitors": _q(lambda s, d: mo.control_monitors(mo.monitor_stats(_ann(s, d), load(s, d, "as_rank")).withColumn("extra_ann", F.col("extra_ann") % 3), 10, 10).select("monitor_asn", "as_rank"), oracle("select monitor_asn, coalesce(as_rank, (select count(*) + 1 from as_rank)) as as_rank from (select monitor_asn, count(distinct net * 64 + len) as n, count(*) as t from announcements group by monitor_asn) m left join as_rank r on m.monitor_asn = r.asn where (t - n) % 3 = 0 and t >= 10 order by 2, 1 limit 10", "announcements", "as_rank")),
    "top_monitors": _q(lambda s, d: mo.top_monitors(mo.monitor_stats(_ann(s, d), load(s, d, "as_rank")), 25).select("monitor_asn", "as_rank"), oracle("select monitor_asn, coalesce(as_rank, (select count(*) + 1 from as_rank)) as as_rank from (select distinct monitor_asn from announcements) m left join as_rank r on m.monitor_asn = r.asn order by 2, 1 limit 25", "announcements", "as_rank")),
    "monitor_rows": _q(lambda s, d: flat(mo.monitor_rows(_ann(s, d), 7)), oracle("select net, len, origin, monitor_asn, time from announcements where monitor_asn = 7", "announcements")),
    "path_distance": _q(lambda s, d: mo.path_distance(_estimates(s, d)).select("monitor_asn", "prefix_id", "distance"), f"select monitor_asn, prefix_id, {_DISTANCE} as distance from ({_PATHS}) x"),
    "mean_path_distance": _q(
        lambda s, d: mo.mean_path_distance(_estimates(s, d)).withColumn("mean_distance", F.round("mean_distance", 9)),
        f"select 'all' as mode, round(avg(d), 9) as mean_distance from (select monitor_asn, avg({_DISTANCE}) as d from ({_PATHS}) x group by monitor_asn) y"),
    "truth_vs_estimate": _q(
        lambda s, d: _estimates(s, d).select("monitor_asn", "prefix_id", F.array_join("as_path", ",").alias("as_path"), F.array_join("estimated", ",").alias("estimated")),
        f"select monitor_asn, prefix_id, array_to_string(truth, ',') as as_path, array_to_string(guess, ',') as estimated from ({_PATHS}) x"),
}


def _estimates(s, d):
    """Observed and estimated paths made from line items: estimates differ in the middle or have a hop more, and a third is missing."""
    base = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("monitor_asn"), F.col("l_orderkey").alias("prefix_id")).agg(F.max("l_partkey").alias("p"), F.max("l_linenumber").alias("ln"))
    truth = base.select("monitor_asn", "prefix_id", F.array(F.col("monitor_asn"), F.col("p") % 9, F.col("monitor_asn") % 40).alias("as_path"), F.lit("all").alias("mode"))
    more = F.when(F.col("ln") % 3 == 2, F.array(F.col("p") % 5)).otherwise(F.array().cast("array<bigint>"))
    estimate = base.where("ln % 3 > 0").select("monitor_asn", "prefix_id", F.concat(F.array(F.col("monitor_asn"), F.col("p") % 7), more, F.array(F.col("monitor_asn") % 40)).alias("as_path"))
    return mo.truth_vs_estimate(truth, estimate)
