"""What-if analysis of route-origin policies, and the tables that are served from it.

``pairs`` are distinct (prefix, origin), ``validity`` adds codes, ``hijacks`` are active (prefix, origin, url), ``inverse``
are the pairs that an AS did not keep (asn, prefix, origin). Policies: asn blocks codes 3 and 4, length blocks 2, rov all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.scalars import BLOCKED, ratio, trunc2, validity_name
from pathweave.functions.stored import stored
from pathweave.operators.metadata import dense_id, distinct_on
from pathweave.operators.topology import neighbours, stubs_to_parents

PAIR = ["prefix", "origin"]


def active_hijacks(hijacks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Hijacks that overlap the window; one without an end goes on."""
    return hijacks.where((F.col("start_time") <= end) & (F.col("end_time").isNull() | (F.col("end_time") >= start)))


def invalid_pairs(validity: DataFrame, policy: str) -> DataFrame:
    return validity.where(F.col("validity").isin(*BLOCKED[policy])).select(*PAIR)


def hijacked_invalid(pairs: DataFrame, validity: DataFrame, hijacks: DataFrame, policy: str) -> DataFrame:
    return pairs.join(invalid_pairs(validity, policy), PAIR).join(hijacks.select(*PAIR, "url"), PAIR).select(*PAIR, "url").distinct()


def not_hijacked_invalid(pairs: DataFrame, validity: DataFrame, hijacks: DataFrame, policy: str) -> DataFrame:
    return pairs.join(invalid_pairs(validity, policy), PAIR).select(*PAIR).distinct().join(hijacks.select(*PAIR), PAIR, "left_anti")


def alternative_pairs(pairs: DataFrame, validity: DataFrame, policy: str) -> DataFrame:
    """Pairs that traffic of an invalid pair could fall back on: the same prefix with another origin, or a strict
    super-prefix, themselves not invalid. Two equi-joins instead of one join on either condition."""
    bad = pairs.join(invalid_pairs(validity, policy), PAIR).select(*PAIR).distinct()
    good = pairs.join(invalid_pairs(validity, policy), PAIR, "left_anti").select(F.col("prefix").alias("extra_prefix"), F.col("origin").alias("extra_origin")).distinct()
    same = bad.join(good, F.col("prefix") == F.col("extra_prefix")).where("origin <> extra_origin")
    above = px.containment_join(bad, good, covering_prefix="extra_prefix", strict=True).withColumnRenamed("covering_prefix_", "extra_prefix")
    columns = [*PAIR, "extra_prefix", "extra_origin"]
    return same.select(*columns).unionByName(above.select(*columns)).distinct()


def interesting_pairs(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*PAIR)
    for p in parts[1:]:
        out = out.unionByName(p.select(*PAIR))
    return out.distinct()


def interesting_announcements(announcements: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """One announcement per (prefix, origin, time) of interesting pairs, that with the least path, numbered from 0."""
    kept = announcements.join(pairs.select(*PAIR), PAIR, "left_semi").select(*PAIR, "time", path)
    one = distinct_on(kept, [*PAIR, "time"], [F.col(path)])
    return dense_id(one, [px.order_key(F.col("prefix")), F.col("origin"), F.col("time")], "ann_id")


def announcement_ids(announcements: DataFrame, pairs: DataFrame) -> DataFrame:
    return announcements.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi").select("ann_id")


def alternative_ids(announcements: DataFrame, alternatives: DataFrame) -> DataFrame:
    extra = announcements.select(F.col("prefix").alias("extra_prefix"), F.col("origin").alias("extra_origin"), F.col("ann_id").alias("extra_id"))
    return announcements.join(alternatives, PAIR).join(extra, ["extra_prefix", "extra_origin"]).select("ann_id", "extra_id")


def ids_after(announcements: DataFrame, ids: DataFrame, cut: int) -> DataFrame:
    return announcements.where(F.col("time") > cut).join(ids, "ann_id", "left_semi").select("ann_id")


def older_alternatives(announcements: DataFrame, alternatives: DataFrame, cut: int) -> DataFrame:
    """Alternatives from before the cut for announcements from after it; those at the cut are neither."""
    times = announcements.select(F.col("ann_id"), F.col("time"))
    both = alternative_ids(announcements, alternatives).join(times, "ann_id").join(times.select(F.col("ann_id").alias("extra_id"), F.col("time").alias("extra_time")), "extra_id")
    return both.where((F.col("time") > cut) & (F.col("extra_time") < cut)).select("ann_id", "extra_id")


def alternatives_by_prefix(announcements: DataFrame, ids: DataFrame) -> DataFrame:
    """For the announcements of ``ids``, all others of a strict super-prefix, or of the same prefix with another origin."""
    asked = announcements.join(ids, "ann_id", "left_semi").select("ann_id", *PAIR)
    others = announcements.select(F.col("ann_id").alias("extra_id"), F.col("prefix").alias("extra_prefix"), F.col("origin").alias("extra_origin"))
    same = asked.join(others, F.col("prefix") == F.col("extra_prefix")).where("origin <> extra_origin and ann_id <> extra_id")
    above = px.containment_join(asked, others, covering_prefix="extra_prefix", strict=True)
    return same.select("ann_id", "extra_id").unionByName(above.select("ann_id", "extra_id")).distinct()


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ann_id").unionByName(b.select("ann_id")).distinct()


def split_validity(validity: DataFrame, hijacks: DataFrame) -> DataFrame:
    """Each pair with what blocks it (asn, length or null) and whether it is a hijack; a row per pair and hijack url."""
    blocked = F.when(F.col("validity").isin(*BLOCKED["asn"]), "asn").when(F.col("validity").isin(*BLOCKED["length"]), "length")
    return validity.join(hijacks.select(*PAIR, "url").distinct(), PAIR, "left").select(*PAIR, blocked.alias("blocked_by"), F.col("url").isNotNull().alias("hijacked"), "url")


def blocks(policy: str) -> Column:
    """Whether a policy blocks a row of ``split_validity``."""
    if policy == "rov":
        return F.col("blocked_by").isNotNull()
    return F.coalesce(F.col("blocked_by") == policy, F.lit(False))


def category(policy: str) -> Column:
    return F.concat(F.when(blocks(policy), "blocked_").otherwise("not_blocked_"), F.when(F.col("hijacked"), "hijacked").otherwise("not_hijacked"))


def hijack_table(split: DataFrame, policy: str, blocked: bool) -> DataFrame:
    return split.where(F.col("hijacked") & (blocks(policy) == F.lit(blocked))).select(*PAIR, "url")


def all_hijacks(split: DataFrame) -> DataFrame:
    return hijack_table(split, "asn", True).unionByName(hijack_table(split, "asn", False))


def local_rib(covered: DataFrame, inverse: DataFrame, asns: DataFrame) -> DataFrame:
    """All covered pairs of each AS but those that it did not keep."""
    own = inverse.join(asns.select("asn").distinct(), "asn", "left_semi").select("asn", *PAIR)
    everything = covered.select(*PAIR).distinct().crossJoin(F.broadcast(asns.select("asn").distinct()))  # the asked ASes only
    return everything.join(own, ["asn", *PAIR], "left_anti").select("asn", *PAIR)


def hijacks_held(split: DataFrame, inverse: DataFrame, asns: DataFrame, policy: str) -> DataFrame:
    """Hijacks that a policy does not block and that the asked ASes hold."""
    open_hijacks = hijack_table(split, policy, False).distinct().crossJoin(F.broadcast(asns.select("asn").distinct()))
    return open_hijacks.join(inverse.select("asn", *PAIR), ["asn", *PAIR], "left_anti").select("asn", *PAIR, "url").withColumn("policy", F.lit(policy))


def kept_totals(covered: DataFrame, inverse: DataFrame) -> DataFrame:
    total = covered.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("all_pairs"))
    missed = inverse.groupBy("asn").agg(F.count(F.lit(1)).alias("missed"))
    return missed.crossJoin(F.broadcast(total)).select("asn", (F.col("all_pairs") - F.col("missed")).alias("total_kept"))  # one row


def category_totals(split: DataFrame, inverse: DataFrame, policy: str) -> DataFrame:
    """Per AS of ``inverse``: pairs that it holds, by whether the policy blocks them and whether they are hijacks."""
    labelled = split.select(*PAIR, category(policy).alias("category")).distinct()
    sizes = labelled.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    names = ["blocked_hijacked", "not_blocked_hijacked", "blocked_not_hijacked", "not_blocked_not_hijacked"]
    size_row = sizes.agg(*[F.coalesce(F.max(F.when(F.col("category") == n, F.col("size"))), F.lit(0)).alias(f"size_{n}") for n in names])
    missed = inverse.select("asn", *PAIR).distinct().join(labelled, PAIR, "left").groupBy("asn").pivot("category", names).count()
    joined = missed.crossJoin(F.broadcast(size_row))  # one row
    return joined.select("asn", *[(F.col(f"size_{n}") - F.coalesce(n, F.lit(0))).alias(n) for n in names])


def policy_totals(split: DataFrame, inverse: DataFrame) -> DataFrame:
    """``category_totals`` of all three policies from one pass over the pairs, a row per AS and ``policy``.

    ``split`` has one validity a pair, so the policy that blocks all invalid pairs is the sum of the other two. The labelled pairs
    are stored, as they are counted and joined. Rows of ``inverse`` are dealt by pair before equal ones become one, for the join too.
    """
    labelled = stored(split.select(*PAIR, F.coalesce("blocked_by", F.lit("none")).alias("by"), "hijacked").distinct())
    kinds = [(by, hijacked) for by in ("asn", "length", "none") for hijacked in (True, False)]
    counts = [F.count(F.when((F.col("by") == by) & (F.col("hijacked") == hijacked), 1)).alias(f"{by}_{hijacked}") for by, hijacked in kinds]
    sizes = labelled.agg(*counts).select(*[F.col(f"{by}_{hijacked}").alias(f"size_{by}_{hijacked}") for by, hijacked in kinds])
    missed = inverse.select("asn", *PAIR).repartition(*PAIR).distinct().join(labelled, PAIR, "left").groupBy("asn").agg(*counts)
    held = missed.crossJoin(F.broadcast(sizes))  # one row

    def total(policy: str, blocked: bool, hijacked: bool) -> Column:
        these = [by for by in ("asn", "length", "none") if (by != "none" and policy in (by, "rov")) == blocked]
        return reduce(lambda a, b: a + b, [F.col(f"size_{by}_{hijacked}") - F.col(f"{by}_{hijacked}") for by in these])

    rows = [
        F.struct(
            F.lit(p).alias("policy"), total(p, True, True).alias("blocked_hijacked"), total(p, False, True).alias("not_blocked_hijacked"),
            total(p, True, False).alias("blocked_not_hijacked"), total(p, False, False).alias("not_blocked_not_hijacked"),
        )
        for p in sorted(BLOCKED)
    ]
    return held.select("asn", F.inline(F.array(*rows)))


def policy_tables(split: DataFrame, inverse: DataFrame) -> DataFrame:
    """``policy_table`` of all three policies, a row per AS and ``policy``."""
    return policy_table(policy_totals(split, inverse), "policy")


def policy_table(totals: DataFrame, *keys: str) -> DataFrame:
    """Totals and percentages, cut to two decimals; null where nothing stands below. ``keys`` are kept beside ``asn``."""
    hijacks = F.col("blocked_hijacked") + F.col("not_blocked_hijacked")
    percent = lambda part, whole: trunc2(ratio(part, whole, 100.0))
    return totals.select(
        "asn", *keys, "blocked_hijacked", "not_blocked_hijacked", "blocked_not_hijacked", "not_blocked_not_hijacked",
        percent(F.col("blocked_hijacked"), hijacks).alias("percent_blocked_hijacked"),
        percent(F.col("not_blocked_hijacked"), hijacks).alias("percent_not_blocked_hijacked"),
        percent(F.col("blocked_not_hijacked"), F.col("blocked_not_hijacked") + F.col("not_blocked_not_hijacked")).alias("percent_blocked_not_hijacked"),
    )


def rov_table(split: DataFrame, inverse: DataFrame) -> DataFrame:
    """The policy that blocks all invalid pairs, which the other two block disjoint parts of: from one pass over the pairs, not from both tables."""
    return policy_table(policy_totals(split, inverse).where("policy = 'rov'"))


def policy_averages(table: DataFrame, policy: str) -> DataFrame:
    """Sum over count of each metric, cut to two decimals."""
    metrics = [c for c in table.columns if c != "asn"]
    return table.agg(*[trunc2(F.sum(c) / F.count(F.lit(1))).alias(c) for c in metrics]).withColumn("policy", F.lit(policy))


def average_over(table: DataFrame, asns: DataFrame) -> DataFrame:
    """Mean of each metric over the asked ASes that have a row."""
    metrics = [c for c in table.columns if c != "asn"]
    return table.join(asns.select("asn").distinct(), "asn", "left_semi").agg(*[F.avg(c).alias(c) for c in metrics])


def id_policy_stats(results: DataFrame, hijacked: DataFrame, not_hijacked: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Per AS of ``results(asn, ann_id)``: announcements held that are hijacks, that are not, and that have no alternative held."""
    flags = hijacked.select("ann_id", F.lit(1).alias("h")).unionByName(not_hijacked.select("ann_id", F.lit(0).alias("h"))).groupBy("ann_id").agg(F.max("h").alias("h"))
    held = results.join(flags, "ann_id")
    backed = held.join(alternatives, "ann_id").join(results.select("asn", F.col("ann_id").alias("extra_id")), ["asn", "extra_id"], "left_semi").select("asn", "ann_id").distinct().withColumn("backed", F.lit(1))
    joined = held.join(backed, ["asn", "ann_id"], "left")
    return joined.groupBy("asn").agg(
        F.sum("h").alias("hijacked"), F.sum(1 - F.col("h")).alias("not_hijacked"), F.sum(F.when(F.col("backed").isNull(), 1).otherwise(0)).alias("no_alternative")
    )


def averages(tables: DataFrame) -> DataFrame:
    """``policy_averages`` of each policy of ``policy_tables``."""
    metrics = [c for c in tables.columns if c not in ("asn", "policy")]
    return tables.groupBy("policy").agg(*[trunc2(F.sum(c) / F.count(F.lit(1))).alias(c) for c in metrics])


def policy_stats(tables: DataFrame, asns: DataFrame, stubs: DataFrame) -> DataFrame:
    """Statistics of the asked ASes (a stub answers as its parent), a row per AS and policy of ``policy_tables``."""
    return tables.join(stubs_to_parents(asns, stubs).select("asn").distinct(), "asn", "left_semi")


def hijack_data(split: DataFrame, inverse: DataFrame, asns: DataFrame, policies: tuple[str, ...] = tuple(sorted(BLOCKED))) -> DataFrame:
    """Hijacks that the asked ASes hold, by policy: ``asn``, pair, ``url``, ``policy``, ``part`` and ``blocked``.

    ``part`` is the policy whose table lists the hijack: the policy itself, but asn and length for rov, which is made of the two.
    """
    parts = {p: ("asn", "length") if p == "rov" else (p,) for p in policies}
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(part).alias("part"), blocks(part).alias("blocked")) for p in policies for part in parts[p]]
    asked = asns.select("asn").distinct()
    hijacks = split.where("hijacked").select(*PAIR, "url", "blocked_by").distinct().crossJoin(F.broadcast(asked))  # the asked ASes only
    held = hijacks.join(inverse.select("asn", *PAIR), ["asn", *PAIR], "left_anti")
    return held.select("asn", *PAIR, "url", F.inline(F.array(*rows)))


def averages_over(tables: DataFrame, asns: DataFrame) -> DataFrame:
    """Mean of each metric of ``policy_tables`` over the asked ASes that have a row, by policy."""
    metrics = [c for c in tables.columns if c not in ("asn", "policy")]
    return tables.join(asns.select("asn").distinct(), "asn", "left_semi").groupBy("policy").agg(*[F.avg(c).alias(c) for c in metrics])


def policy_answer(split: DataFrame, inverse: DataFrame, asns: DataFrame, stubs: DataFrame, policies: tuple[str, ...] = tuple(sorted(BLOCKED))) -> dict[str, DataFrame]:
    """What is served for the asked ASes and policies: their ``stats``, their ``hijacks``, and ``averages`` over the asked ASes."""
    asked = stubs_to_parents(asns, stubs).select("asn").distinct()
    stats = policy_tables(split, inverse).where(F.col("policy").isin(*policies)).join(asked, "asn", "left_semi")
    return {"stats": stats, "hijacks": hijack_data(split, inverse, asked, policies), "averages": averages_over(stats, asked)}


def rib_of(covered: DataFrame, inverse: DataFrame, asns: DataFrame, stubs: DataFrame) -> DataFrame:
    return local_rib(covered, inverse, stubs_to_parents(asns, stubs))


def relationships_of(pc: DataFrame, peers: DataFrame, asns: DataFrame, stubs: DataFrame) -> DataFrame:
    return neighbours(pc, peers, stubs_to_parents(asns, stubs))


def roa_table(roas: DataFrame) -> DataFrame:
    return roas.select("asn", "prefix", "max_length")


def validity_table(validity: DataFrame) -> DataFrame:
    return validity.select(*PAIR, "validity", validity_name(F.col("validity")).alias("validity_name"))
