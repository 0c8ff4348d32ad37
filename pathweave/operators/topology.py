"""AS topology from two edge tables: ``provider_customers(provider_as, customer_as)`` and ``peers(peer_as_1, peer_as_2)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.stored import stored


def edge_endpoints(pc: DataFrame, peers: DataFrame) -> DataFrame:
    sides = [pc.select(F.col("provider_as").alias("asn")), pc.select(F.col("customer_as").alias("asn")), peers.select(F.col("peer_as_1").alias("asn")), peers.select(F.col("peer_as_2").alias("asn"))]
    return reduce(DataFrame.unionByName, sides)


def all_ases(pc: DataFrame, peers: DataFrame) -> DataFrame:
    return edge_endpoints(pc, peers).distinct()


def count_ases(pc: DataFrame, peers: DataFrame) -> DataFrame:
    return edge_endpoints(pc, peers).agg(F.count_distinct("asn").alias("total_ases"))


def connectivity(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """Customers plus peers of every AS; 0 for an AS that has only providers."""
    ones = [pc.select(F.col("provider_as").alias("asn")), peers.select(F.col("peer_as_1").alias("asn")), peers.select(F.col("peer_as_2").alias("asn"))]
    links = reduce(DataFrame.unionByName, ones).withColumn("n", F.lit(1)).unionByName(pc.select(F.col("customer_as").alias("asn"), F.lit(0).alias("n")))
    return links.groupBy("asn").agg(F.sum("n").alias("connectivity"))


def neighbour_rows(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """Every AS with each neighbour and what that is to it: peer, customer or provider."""
    row = lambda df, a, b, kind: df.select(F.col(a).alias("asn"), F.col(b).alias("neighbour"), F.lit(kind).alias("kind"))
    sides = [row(peers, "peer_as_1", "peer_as_2", "peer"), row(peers, "peer_as_2", "peer_as_1", "peer"), row(pc, "provider_as", "customer_as", "customer"), row(pc, "customer_as", "provider_as", "provider")]
    return reduce(DataFrame.unionByName, sides)


def neighbours(pc: DataFrame, peers: DataFrame, asns: DataFrame) -> DataFrame:
    return neighbour_rows(pc, peers).join(asns.select("asn").distinct(), "asn", "left_semi").distinct()


def as_adjacency(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """Sorted neighbour arrays by kind, whether the AS is a stub or multihomed, and its customers that are stubs."""
    rows = neighbour_rows(pc, peers)
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("neighbour"))))
    arrays = rows.groupBy("asn").agg(of("peer").alias("peers"), of("customer").alias("customers"), of("provider").alias("providers"))
    arrays = arrays.withColumn("stub", (F.size("peers") == 0) & (F.size("customers") == 0)).withColumn("multihomed", F.col("stub") & (F.size("providers") > 1))
    stubs = arrays.where("stub").select(F.col("asn").alias("customer_as"))
    held = pc.join(stubs, "customer_as", "left_semi").groupBy(F.col("provider_as").alias("asn")).agg(F.array_sort(F.collect_set("customer_as")).alias("stubs"))
    return arrays.join(held, "asn", "left").withColumn("stubs", F.coalesce("stubs", F.array().cast("array<bigint>")))


def stub_flags(pc: DataFrame, peers: DataFrame) -> DataFrame:
    return as_adjacency(pc, peers).select("asn", "stub", "multihomed")


def edge_as_count(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """ASes that provide for none and have exactly one link."""
    single = edge_endpoints(pc, peers).groupBy("asn").count().where("count = 1")
    return single.join(pc.select(F.col("provider_as").alias("asn")), "asn", "left_anti").agg(F.count(F.lit(1)).alias("edge_ases"))


def multihomed_count(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """ASes that are customers only, with more than one provider."""
    others = pc.select(F.col("provider_as").alias("asn")).unionByName(peers.select(F.col("peer_as_1").alias("asn"))).unionByName(peers.select(F.col("peer_as_2").alias("asn")))
    only = pc.select(F.col("customer_as").alias("asn"), "provider_as").join(others, "asn", "left_anti")
    return only.groupBy("asn").agg(F.count_distinct("provider_as").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("multihomed_ases"))


def peer_only_count(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """ASes with peers only, and more than one link to them."""
    ends = peers.select(F.col("peer_as_1").alias("asn")).unionByName(peers.select(F.col("peer_as_2").alias("asn")))
    roles = pc.select(F.col("provider_as").alias("asn")).unionByName(pc.select(F.col("customer_as").alias("asn")))
    return ends.join(roles, "asn", "left_anti").groupBy("asn").count().where("count > 1").agg(F.count(F.lit(1)).alias("peer_only_ases"))


def topology_summary(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """One row of (metric, value) each; transit ASes are those neither edge nor multihomed."""
    parts = [count_ases(pc, peers), edge_as_count(pc, peers), multihomed_count(pc, peers), peer_only_count(pc, peers)]
    parts += [pc.agg(F.count(F.lit(1)).alias("customer_links")), peers.agg(F.count(F.lit(1)).alias("peer_links"))]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    one = one.withColumn("transit_ases", F.col("total_ases") - F.col("edge_ases") - F.col("multihomed_ases"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns])))


def links(pc: DataFrame, peers: DataFrame) -> DataFrame:
    return peers.select(F.col("peer_as_1").alias("a"), F.col("peer_as_2").alias("b")).unionByName(pc.select(F.col("provider_as").alias("a"), F.col("customer_as").alias("b"))).distinct()


def stubs_to_parents(df: DataFrame, stubs: DataFrame) -> DataFrame:
    """Replaces a stub's asn by its parent's; ``stubs`` has ``stub_asn, parent_asn``."""
    return df.join(stubs, F.col("asn") == F.col("stub_asn"), "left").withColumn("asn", F.coalesce("parent_asn", "asn")).drop("stub_asn", "parent_asn")


def stub_parents(pc: DataFrame, peers: DataFrame) -> DataFrame:
    """Each stub with its smallest provider."""
    stub = as_adjacency(pc, peers).where("stub")
    return stub.select(F.col("asn").alias("stub_asn"), F.array_min("providers").alias("parent_asn"))


def as_segments(ases: DataFrame, rank: DataFrame, conn: DataFrame, top: int = 100) -> DataFrame:
    """Segment of each AS: top (rank up to ``top``), else edge (no customers or peers), else etc."""
    joined = ases.select("asn").join(rank.select("asn", "as_rank"), "asn", "left").join(conn, "asn", "left")
    return joined.select("asn", F.when(F.col("as_rank") <= top, "top").when(F.col("connectivity") == 0, "edge").otherwise("etc").alias("segment"))


def seed_as(conn: DataFrame, cap: int) -> DataFrame:
    return conn.where(F.col("connectivity") < cap).orderBy(F.col("connectivity").desc(), "asn").limit(1)


def k_hop(link_table: DataFrame, seed: int, k: int) -> DataFrame:
    """ASes within ``k`` links of the seed and their distance: a frontier that grows by one join a step, never back to what it has seen."""
    both = link_table.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(link_table.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = stored(both)
    seen = link_table.sparkSession.range(1).select(F.lit(seed).cast("long").alias("asn"), F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, k + 1):
        reached = both.join(frontier.select(F.col("asn").alias("x")), "x").select(F.col("y").alias("asn")).distinct()
        frontier = stored(reached.join(seen, "asn", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def restrict_to_links(df: DataFrame, link_table: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of ``df`` that occur in the link set."""
    keep = link_table.select(F.col("a").alias(a), F.col("b").alias(b))
    return df.join(keep, [a, b], "left_semi")


def restrict_to_linked(df: DataFrame, link_table: DataFrame, asn: str = "asn") -> DataFrame:
    """Rows of ``df`` whose AS stands in the link set, on either side; ``unlinked`` gives the others."""
    return df.join(_linked(link_table, asn), asn, "left_semi")


def unlinked(df: DataFrame, link_table: DataFrame, asn: str = "asn") -> DataFrame:
    return df.join(_linked(link_table, asn), asn, "left_anti")


def _linked(link_table: DataFrame, asn: str) -> DataFrame:
    return link_table.select(F.explode(F.array("a", "b")).alias(asn)).distinct()


def top_ases(rank: DataFrame, n: int = 100) -> DataFrame:
    return rank.orderBy("as_rank").limit(n)


def rank_window(rank: DataFrame, first: int, last: int) -> DataFrame:
    return rank.where(F.col("as_rank").between(first, last))
