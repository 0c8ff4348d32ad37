"""Outcomes of trials: traces through forwarding tables, counts by segment, rates and confidence intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.scalars import TERMINALS
from pathweave.functions.stored import stored


def terminal_name(asn: Column) -> Column:
    out = None
    for number, name in TERMINALS.items():
        out = F.when(asn == number, name) if out is None else out.when(asn == number, name)
    return out


def trace_back(forwarding: DataFrame, max_hops: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """Where following ``received_from_asn`` ends: ``keys, asn, next, condition``, one row per row of ``forwarding``.

    One row per AS (and keys) is assumed. Pointer doubling: after step k each pointer has gone 2^k hops, so log2(max_hops)
    self-joins are enough. A pointer to an AS without a row stays; ``condition`` is null where no terminal is reached.
    """
    return _jumps(forwarding, max_hops, keys)[-1].withColumn("condition", terminal_name(F.col("next")))


def _jumps(forwarding: DataFrame, max_hops: int, keys: tuple[str, ...]) -> list[DataFrame]:
    """Where 1, 2, 4, ... hops lead, up to ``max_hops`` or the next power of two; every step is stored for the next one.

    Ends early when no trace has gone further in a step, as all have then ended.
    """
    jumps = [stored(forwarding.select(*keys, "asn", F.col("received_from_asn").alias("next")))]
    while 1 << (len(jumps) - 1) < max_hops:
        table = jumps[-1]
        ahead = table.select(*keys, F.col("asn").alias("next"), F.col("next").alias("_far"))
        step = stored(table.join(ahead, [*keys, "next"], "left").select(*keys, "asn", F.coalesce("_far", "next").alias("next"), F.col("_far").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            break
        jumps.append(step.drop("_moved"))
    return jumps


def loop_report(forwarding: DataFrame, max_hops: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """ASes whose trace has not ended: ``keys, asn, next, path``, where it then was and the ASes it passed through, itself first.

    Only these ASes' paths are made, with the jumps of the trace: each step fills the places half-way between those known.
    A trace that stops at an AS without a row has the path up to there.
    """
    *jumps, last = _jumps(forwarding, max_hops, keys)
    stuck = last.where(terminal_name(F.col("next")).isNull())
    places = stuck.select(*keys, F.col("asn").alias("start"), F.lit(0).alias("hop"), F.col("asn").alias("at"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(*keys, F.col("asn").alias("at"), F.col("next").alias("_to"))
        further = places.join(jump, [*keys, "at"]).select(*keys, "start", (F.col("hop") + (1 << k)).alias("hop"), F.col("_to").alias("at"))
        places = places.unionByName(further)
    # A jump past the end of a trace stays at an AS without a row.
    places = places.join(jumps[0].select(*keys, F.col("asn").alias("at")) if jumps else last.select(*keys, F.col("asn").alias("at")), [*keys, "at"], "left_semi")
    paths = places.groupBy(*keys, F.col("start").alias("asn")).agg(F.array_sort(F.collect_list(F.struct("hop", "at"))).alias("_places"))
    return stuck.join(paths.select(*keys, "asn", F.col("_places.at").alias("path")), [*keys, "asn"])


def segment_forwarding(forwarding: DataFrame, segments: DataFrame) -> DataFrame:
    return forwarding.join(segments, "asn")


def percent_sample(segments: DataFrame, percent: Column | int, exclude: int | None = None, seed: int = 0) -> DataFrame:
    """A reproducible share of each segment: ``implement`` is true for n * percent div 100 of its rows.

    At 0 percent one row of the edge segment and none of the others; at 100 percent one row less than all.
    """
    percent = F.lit(percent) if isinstance(percent, int) else percent
    rows = segments if exclude is None else segments.where(F.col("asn") != exclude)
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"))
    amount = F.when(percent == 0, F.when(F.col("segment") == "edge", 1).otherwise(0)).when(percent == 100, F.col("_n") - 1).otherwise(F.floor(F.col("_n") * percent / 100))
    # The hash's bound is found from counts of hash cells, and only the cell at the bound is ordered.
    cell = F.pmod(F.col("_h"), F.lit(1024)).cast("int")
    hashed = rows.withColumn("_h", F.xxhash64("asn", F.lit(seed))).withColumn("_cell", cell)
    cells = hashed.groupBy("segment", "_cell").agg(F.count(F.lit(1)).alias("_k"))
    before = cells.withColumn("_before", F.coalesce(F.sum("_k").over(Window.partitionBy("segment").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = hashed.join(before, ["segment", "_cell"]).join(sizes, "segment")
    place = F.row_number().over(Window.partitionBy("segment", "_cell").orderBy("_h", "asn")) + F.col("_before")
    return placed.withColumn("implement", place <= amount).select(*segments.columns, "implement")


def apply_policy(segments: DataFrame, code: int) -> DataFrame:
    return segments.withColumn("as_type", F.when(F.col("implement"), code).otherwise(0))


def control_plane_counts(forwarding: DataFrame, attacker: int, victim: int, keys: tuple[str, ...] = ("implement",)) -> DataFrame:
    """Rows by origin: attacker, victim or blackhole (64512), without the rows of attacker and victim."""
    rows = forwarding.where(~F.col("asn").isin(attacker, victim))
    count = lambda origin: F.sum(F.when(F.col("origin") == origin, 1).otherwise(0))
    return rows.groupBy(*keys).agg(count(attacker).alias("c_hijacked"), count(victim).alias("c_not_hijacked"), count(64512).alias("c_blackholed"))


def data_plane_counts(traced: DataFrame, keys: tuple[str, ...] = ("implement",)) -> DataFrame:
    count = lambda name: F.sum(F.when(F.col("condition") == name, 1).otherwise(0))
    counts = traced.groupBy(*keys).agg(count("hijacked").alias("hijacked"), count("not_hijacked").alias("not_hijacked"), count("blackholed").alias("blackholed"))
    return counts.withColumn("total", F.col("hijacked") + F.col("not_hijacked") + F.col("blackholed"))


def no_rib_counts(segments: DataFrame, forwarding: DataFrame, exclude: tuple[int, ...] = (), keys: tuple[str, ...] = ("implement",)) -> DataFrame:
    rows = segments.where(~F.col("asn").isin(*exclude)) if exclude else segments
    return rows.join(forwarding.select("asn"), "asn", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("no_rib"))


def visible_hijacks(forwarding: DataFrame, attacker_announcements: DataFrame, keys: tuple[str, ...] = ("implement",)) -> DataFrame:
    """Rows whose next hop holds an announcement of the attacker."""
    holders = forwarding.join(attacker_announcements.select("prefix", "origin").distinct(), ["prefix", "origin"], "left_semi").select(F.col("asn").alias("received_from_asn")).distinct()
    return forwarding.join(holders, "received_from_asn", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("visible_hijacks"))


#: Whom a count is over: ASes of a segment that adopt the policy, and those that don't.
SIDES = ("adopting", "collateral")
#: Columns that describe a trial.
TRIAL_INFO = (
    "attack_type", "number_of_attackers", "attacker_asn", "attacker_prefixes", "victim", "victim_prefixes", "adopt_pol", "percent", "percent_iter", "round_num",
    "extra_bash_arg_1", "extra_bash_arg_2", "extra_bash_arg_3", "extra_bash_arg_4", "extra_bash_arg_5",
)
#: What trials are averaged by.
RESULT_KEYS = (
    "adopt_pol", "attack_type", "number_of_attackers", "subtable_name", "percent", "round_num",
    "extra_bash_arg_1", "extra_bash_arg_2", "extra_bash_arg_3", "extra_bash_arg_4", "extra_bash_arg_5",
)
#: Rates of each side: name -> (counts that are added, counts that are taken off).
RATES = {
    "trace_hijacked": (("trace_hijacked",), ()),
    "trace_disconnected": (("trace_blackholed", "no_rib"), ()),
    "trace_connected": (("trace_nothijacked",), ()),
    "c_plane_hijacked": (("c_plane_has_attacker_prefix_origin",), ()),
    "c_plane_disconnected": (("c_plane_has_bhole", "no_rib"), ()),
    "c_plane_connected": (("c_plane_has_only_victim_prefix_origin",), ()),
    "visible_hijacks": (("visible_hijacks",), ()),
    "hidden_hijacks": (("trace_hijacked",), ("visible_hijacks",)),
}
#: All measures: each rate of each side.
MEASURES = tuple(f"{rate}_{side}" for side in SIDES for rate in RATES)


def visible_ases(trials: DataFrame, forwarding: DataFrame) -> DataFrame:
    """``trial, asn`` of each row whose next hop holds a prefix of the attacker with the attacker as its origin."""
    attack = trials.select("trial", "attacker_asn", F.explode(F.array_distinct("attacker_prefixes")).alias("prefix"))
    mine = (forwarding["trial"] == attack["trial"]) & (forwarding["origin"] == attack["attacker_asn"]) & (forwarding["prefix"] == attack["prefix"])
    holders = forwarding.join(attack, mine, "left_semi").select("trial", F.col("asn").alias("received_from_asn")).distinct()
    return forwarding.join(holders, ["trial", "received_from_asn"], "left_semi").select("trial", "asn")


def as_outcomes(trials: DataFrame, segments: DataFrame, forwarding: DataFrame, max_hops: int = 64) -> DataFrame:
    """A row per trial, segment and AS: ``trial, subtable_name, asn, implement, origin, next, has_rib, visible``.

    Everything known of an AS meets in one aggregation over tagged rows (its segments, its forwarding row, where its trace
    ends, whether its hijack is visible), which all have the key (trial, asn), instead of a join for each.
    """
    forwarding = forwarding.select("trial", "asn", "prefix", "origin", "received_from_asn")
    blank = {"segment": "struct<subtable_name:string,implement:boolean>", "origin": "bigint", "next": "bigint", "has_rib": "boolean", "visible": "boolean"}

    def tagged(df: DataFrame, **known: Column) -> DataFrame:
        return df.select(F.col("trial").cast("bigint").alias("trial"), F.col("asn").cast("bigint").alias("asn"), *[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in blank.items()])

    rows = [
        tagged(segments, segment=F.struct("subtable_name", F.coalesce("implement", F.lit(False)))),
        tagged(forwarding, origin=F.col("origin"), has_rib=F.lit(True)),
        tagged(trace_back(forwarding, max_hops, ("trial",)), next=F.col("next")),
        tagged(visible_ases(trials, forwarding), visible=F.lit(True)),
    ]
    met = reduce(DataFrame.unionByName, rows).groupBy("trial", "asn").agg(
        F.collect_set("segment").alias("segments"), F.max("origin").alias("origin"), F.max("next").alias("next"), F.max("has_rib").alias("has_rib"), F.max("visible").alias("visible")
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_rib", "visible")]
    return met.select("trial", "asn", F.explode("segments").alias("_s"), "origin", "next", *flags).select("trial", "_s.*", "asn", "origin", "next", "has_rib", "visible")


def trial_facts(trials: DataFrame, segments: DataFrame, forwarding: DataFrame, max_hops: int = 64) -> DataFrame:
    """One row per trial and segment with all counts by side: the columns of ``TRIAL_INFO``, ``subtable_name`` and 18 counts.

    ``trials`` has a row per ``trial`` with ``TRIAL_INFO``; ``segments`` has ``trial, asn, subtable_name, implement``, where an AS may
    stand in several segments; ``forwarding`` has ``trial, asn, prefix, origin, received_from_asn``, one row per trial and AS
    (``most_specific_per_as`` gives these), as a trace takes one. Attacker and victim are not counted, but for visible hijacks.
    An AS of a segment without a forwarding row has no RIB and is part of the totals, as is each AS whose trace ends; one whose
    trace doesn't end is in none of the traces. A count without rows is 0.
    """
    info = trials.select("trial", *TRIAL_INFO)
    # Few rows per AS against one a trial: Spark broadcasts the attacks while they are small and shuffles by trial beyond that.
    ases = as_outcomes(trials, segments, forwarding, max_hops).join(info.select("trial", "attacker_asn", "victim"), "trial")
    others = (F.col("asn") != F.col("attacker_asn")) & (F.col("asn") != F.col("victim"))
    cases = {
        "trace_hijacked": others & (terminal_name(F.col("next")) == "hijacked"),
        "trace_nothijacked": others & (terminal_name(F.col("next")) == "not_hijacked"),
        "trace_blackholed": others & (terminal_name(F.col("next")) == "blackholed"),
        "c_plane_has_attacker_prefix_origin": others & (F.col("origin") == F.col("attacker_asn")),
        "c_plane_has_only_victim_prefix_origin": others & (F.col("origin") == F.col("victim")),
        "c_plane_has_bhole": others & (F.col("origin") == 64512),
        "no_rib": others & ~F.col("has_rib"),
        "visible_hijacks": F.col("visible"),
    }
    sides = {"adopting": F.col("implement"), "collateral": ~F.col("implement")}
    counts = ases.groupBy("trial", "subtable_name").agg(*[F.count(F.when(case & here, 1)).alias(f"{name}_{side}") for name, case in cases.items() for side, here in sides.items()])
    totals = {f"trace_total_{s}": reduce(lambda a, b: a + b, [F.col(f"{n}_{s}") for n in ("trace_hijacked", "trace_nothijacked", "trace_blackholed", "no_rib")]) for s in SIDES}
    return counts.withColumns(totals).join(info, "trial")


def rates_over(facts: DataFrame, counts: list[str], total: str) -> DataFrame:
    """Each count over the total; rows with a zero total drop out."""
    rest = [c for c in facts.columns if c not in (*counts, total)]
    return facts.where(F.col(total) > 0).select(*rest, *[(F.col(c) / F.col(total)).alias(f"{c}_rate") for c in counts])


def trial_rates(facts: DataFrame) -> DataFrame:
    """The 16 ``MEASURES`` of each row of ``trial_facts``, over the side's total, beside ``RESULT_KEYS``; rows of which a side's total is zero drop out."""

    def rate(name: str, side: str) -> Column:
        plus, minus = RATES[name]
        top = reduce(lambda a, b: a + b, [F.col(f"{c}_{side}") for c in plus])
        for c in minus:
            top = top - F.col(f"{c}_{side}")
        return (top.cast("double") / F.col(f"trace_total_{side}")).alias(f"{name}_{side}")

    whole = facts.where((F.col("trace_total_adopting") > 0) & (F.col("trace_total_collateral") > 0))
    return whole.select(*RESULT_KEYS, *[rate(name, side) for side in SIDES for name in RATES])


def mean_ci95(rates: DataFrame, keys: tuple[str, ...] | list[str] = RESULT_KEYS, metrics: tuple[str, ...] | list[str] = MEASURES) -> DataFrame:
    """Mean and half-width of the 95 % confidence interval of each measure; null width for one trial. Null keys are a group."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), (F.lit(1.96) * F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_ci95")]
    return rates.groupBy(*keys).agg(*out)


def check_percent_index(df: DataFrame) -> DataFrame:
    """Percents that stand with more than one iteration number: ``percent, n``. A null number counts as one."""
    return df.select("percent", "percent_iter").distinct().groupBy("percent").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def require_percent_index(df: DataFrame) -> DataFrame:
    """``df`` itself, after a check that each percent has one iteration number; else a ValueError that names up to five percents."""
    bad = [r.percent for r in check_percent_index(df).orderBy("percent").limit(5).collect()]
    if bad:
        raise ValueError(f"percents with more than one iteration number: {bad}")
    return df


def attribute_values(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])


def attribute_grid(values: DataFrame, cols: list[str]) -> DataFrame:
    """All combinations of the attribute values of one row of arrays."""
    out = values.select(*cols)
    for c in cols:
        out = out.withColumn(c, F.explode(c))
    return out


def compare_policies(results: DataFrame, keys: list[str], policy_col: str, a: str, b: str, metric: str) -> DataFrame:
    left = results.where(F.col(policy_col) == a).select(*keys, F.col(metric).alias("value_a"))
    right = results.where(F.col(policy_col) == b).select(*keys, F.col(metric).alias("value_b"))
    return left.join(right, keys).withColumn("difference", F.col("value_a") - F.col("value_b"))


def series_order(df: DataFrame, x: str, points: list) -> DataFrame:
    return df.where(F.col(x).isin(points)).orderBy(x)


def plot_series(
    intervals: DataFrame, x: str, points: list, attributes: dict[str, object] | None = None, policies: list[str] | None = None, measures: tuple[str, ...] | list[str] = MEASURES, keys: tuple[str, ...] | list[str] = RESULT_KEYS
) -> DataFrame:
    """All series in long form from one job: the keys but ``x``, then ``x``, ``measure``, ``y`` and ``error`` in percent, in order of x.

    ``intervals`` is what ``mean_ci95`` gives. ``attributes`` fixes keys to values, where None asks for nulls; ``policies`` are those of
    ``adopt_pol`` to be shown, all if None.
    """
    for name, value in (attributes or {}).items():
        intervals = intervals.where(F.col(name).eqNullSafe(F.lit(value)))
    if policies is not None:
        intervals = intervals.where(F.col("adopt_pol").isin(policies))
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"{m}_mean") * 100).alias("y"), (F.col(f"{m}_ci95") * 100).alias("error")) for m in measures])
    return series_order(intervals, x, points).select(*[k for k in keys if k != x], F.col(x).alias("x"), F.inline(rows))
