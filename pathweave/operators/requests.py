"""Answers to requests from served tables: policy statistics, averages, hijacks, relationships and local RIBs of asked ASes.

``publish`` stores what the what-if analysis gives, once per change of its inputs. A request then reads buckets of asked ASes.
Asked ASes come as a list, as a request names them; a stub answers as its parent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.scalars import BLOCKED
from pathweave.operators import topology as tp
from pathweave.operators import whatif as wi
from pathweave.sources import serving

POLICIES = tuple(sorted(BLOCKED))
#: To be raised when what the served tables hold changes, so that all of them are made anew.
VERSION = 1


def publish(spark: SparkSession, path: str, sources: dict[str, Callable[[], DataFrame]], inputs: dict[str, list[str]]) -> list[str]:
    """Make or renew all served tables below ``path``; gives the names of those made.

    ``sources`` make ``split`` (see ``whatif.split_validity``), ``covered``, ``inverse``, ``pc`` and ``peers``, and are called only if a
    file of the inputs has changed; ``split`` is made once for all tables that need it. ``inputs`` has the paths of the files behind
    ``study`` (split and covered), ``inverse`` and ``graph`` (pc and peers).
    """
    state = serving.fingerprint(spark, inputs)
    at = lambda name: f"{path}/{name}"
    made = []

    def refresh(name: str, build: Callable[[], DataFrame], of: tuple[str, ...], key: str | None = None) -> None:
        if serving.refresh(spark, at(name), build, {n: state[n] for n in of} | {"version": str(VERSION)}, key):
            made.append(name)

    refresh("split", sources["split"], ("study",))
    refresh("covered", lambda: sources["covered"]().select(*wi.PAIR).distinct(), ("study",))
    refresh("inverse", lambda: sources["inverse"]().select("asn", *wi.PAIR).distinct(), ("inverse",), "asn")
    refresh("hijacks", lambda: serving.lookup(spark, at("split")).where("hijacked"), ("study",))
    refresh("policies", lambda: wi.policy_tables(serving.lookup(spark, at("split")), serving.lookup(spark, at("inverse"))), ("study", "inverse"), "asn")
    refresh("averages", lambda: wi.averages(serving.lookup(spark, at("policies"))), ("study", "inverse"))
    refresh("relationships", lambda: tp.neighbour_rows(sources["pc"](), sources["peers"]()).distinct(), ("graph",), "asn")
    refresh("stubs", lambda: tp.stub_parents(sources["pc"](), sources["peers"]()), ("graph",), "stub_asn")
    return made


def resolved(spark: SparkSession, path: str, asns: Iterable[int]) -> list[int]:
    """The asked ASes, each stub as its parent: at most as many as asked."""
    asked = sorted(set(asns))
    parents = {r.stub_asn: r.parent_asn for r in serving.lookup(spark, f"{path}/stubs", asked).select("stub_asn", "parent_asn").collect()}
    return sorted({parents.get(a, a) for a in asked})


def averages(spark: SparkSession, path: str) -> DataFrame:
    return serving.lookup(spark, f"{path}/averages")


def all_hijacks(spark: SparkSession, path: str) -> DataFrame:
    return serving.lookup(spark, f"{path}/hijacks").select(*wi.PAIR, "url")


def hijacks(spark: SparkSession, path: str, policy: str, blocked: bool) -> DataFrame:
    return wi.hijack_table(serving.lookup(spark, f"{path}/hijacks"), policy, blocked)


def relationships(spark: SparkSession, path: str, asns: Iterable[int]) -> DataFrame:
    return serving.lookup(spark, f"{path}/relationships", resolved(spark, path, asns))


def local_rib(spark: SparkSession, path: str, asns: Iterable[int]) -> DataFrame:
    """All covered pairs of each asked AS but those that it did not keep."""
    asked = resolved(spark, path, asns)
    return wi.local_rib(serving.lookup(spark, f"{path}/covered"), serving.lookup(spark, f"{path}/inverse", asked), _frame(spark, asked))


def policy_answer(spark: SparkSession, path: str, asns: Iterable[int], policies: tuple[str, ...] = POLICIES) -> dict[str, DataFrame]:
    """``stats`` and ``hijacks`` of the asked ASes by policy, and ``averages`` over them."""
    asked = resolved(spark, path, asns)
    stats = serving.lookup(spark, f"{path}/policies", asked).where(F.col("policy").isin(*policies))
    held = wi.hijack_data(serving.lookup(spark, f"{path}/hijacks"), serving.lookup(spark, f"{path}/inverse", asked), _frame(spark, asked), policies)
    return {"stats": stats, "hijacks": held, "averages": wi.averages_over(stats, _frame(spark, asked))}


def _frame(spark: SparkSession, asns: list[int]) -> DataFrame:
    return spark.createDataFrame([(a,) for a in asns], "asn long")
