"""Queries that answer from served tables, which are made once for a folder of inputs and again when these change, and queries
that write tables and read them again."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.stored import checkpoint_folder
from pathweave.operators import requests as rq
from pathweave.operators import validation as va
from pathweave.operators import whatif as wi
from pathweave.plans import study_queries as study
from pathweave.plans.views import flat, load, oracle
from pathweave.sources import sinks, text

#: ASes that a request names: two stubs and an AS that is none.
ASKED = (3, 500, 501)


def publish(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the served tables for ``sf_dir``, made or renewed if need be."""
    path = f"{checkpoint_folder(spark)}/served-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    table = lambda name: load(spark, sf_dir, name)
    sources = {
        "split": lambda: wi.split_validity(va.validated_pairs(table("announcements"), table("roas")), table("hijacks")),
        "covered": lambda: va.covered_announcements(table("announcements"), table("roas"), ("prefix", "origin")),
        "inverse": lambda: table("inverse_results"), "pc": lambda: table("provider_customers"), "peers": lambda: table("peers"),
    }
    files = {"study": ("lineitem", "supplier", "events"), "inverse": ("lineitem",), "graph": ("orders",)}
    rq.publish(spark, path, sources, {name: [f"{sf_dir}/{t}.parquet" for t in tables] for name, tables in files.items()})
    return path


def _served(answer, shown=lambda df: df):
    return lambda s, d: shown(answer(s, publish(s, d)))


def _new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "hijack_events").select("event_number", "start_time", "end_time", "origin", "url")


def _write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced, then appended to."""
    path, events = _new_folder(spark), _events(spark, sf_dir)
    sinks.write_table(events.limit(1), path, "overwrite")
    sinks.write_table(events, path, "overwrite")
    sinks.write_table(events.where("end_time is null"), path)
    return spark.read.parquet(path)


def _export_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = _new_folder(spark), _events(spark, sf_dir)
    sinks.export_tsv(events, path)
    return text.read_stage(spark, path, "event_number long, start_time long, end_time long, origin long, url string")


def _export_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_folder(spark)
    sinks.export_pairs_gz(va.distinct_pairs(load(spark, sf_dir, "announcements")), path)
    rows = text.read_stage(spark, path, "origin long, prefix string, placeholder int")
    return rows.select("origin", F.split_part("prefix", F.lit("/"), F.lit(2)).cast("int").alias("len"), "placeholder")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then all; going back to half is refused."""
    path, events = _new_folder(spark), _events(spark, sf_dir)
    half = events.where("event_number % 2 = 0")
    sinks.promote_if_not_smaller(half, path)
    sinks.promote_if_not_smaller(events, path)
    try:
        sinks.promote_if_not_smaller(half, path)
    except ValueError:
        return sinks.snapshot(spark, path)
    raise AssertionError("a smaller snapshot was taken")


def _restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = _new_folder(spark), _events(spark, sf_dir)
    sinks.promote_if_not_smaller(events, path)
    return sinks.restore_if_empty(events.limit(0), path)


def _continents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their regions as a JSON object in a file, read as rows."""
    path = _new_folder(spark)
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name"))).alias("m"))  # one row a nation
    pairs.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return text.continent_lookup(spark, path)


_E = oracle("select event_number, start_time, end_time, origin, url from hijack_events", "hijack_events")
_ASKED_SQL = {"asked": f"select distinct coalesce(parent_asn, r.asn) as asn from (select unnest([{', '.join(map(str, ASKED))}]) as asn) r left join stubs on r.asn = stub_asn"}
_EXTRA = study._STUBS | study._TABLES | _ASKED_SQL
_ALL = ("split", "inverse_results", "provider_customers", "peers")
_STATS = " union all ".join(f"select *, '{p}' as policy from t_{p} where asn in (select asn from asked)" for p in study._CODES)
_MEANS = [f"round(avg({m}), 6) as {m}" for m in study._METRICS]
_HELD = " union all ".join(
    f"select h.net, h.len, h.origin, h.url, a.asn, '{p}' as policy, '{part}' as part, coalesce(h.blocked_by = '{part}', false) as blocked from (select distinct net, len, origin, url, blocked_by from split where hijacked) h cross join asked a where not exists (select 1 from inverse_results i where i.asn = a.asn and {study._same('i', 'h')})"
    for p, parts in study._PARTS.items() for part in parts
)

QUERIES = {
    "served_averages": (_served(rq.averages), oracle(" union all ".join(study._AVG.values()), "split", "inverse_results", extra=study._TABLES)),
    "served_all_hijacks": (_served(rq.all_hijacks, flat), oracle("select net, len, origin, url from split where hijacked", "split")),
    "served_hijacks_blocked_by_asn": (_served(lambda s, p: rq.hijacks(s, p, "asn", True), flat), oracle("select net, len, origin, url from split where hijacked and blocked_by = 'asn'", "split")),
    "served_hijacks_not_blocked_by_length": (_served(lambda s, p: rq.hijacks(s, p, "length", False), flat), oracle("select net, len, origin, url from split where hijacked and coalesce(blocked_by <> 'length', true)", "split")),
    "served_relationships": (
        _served(lambda s, p: rq.relationships(s, p, ASKED)),
        oracle(f"select distinct asn, neighbour, kind from ({study._NEIGH}) n where asn in (select asn from asked)", "provider_customers", "peers", extra=study._STUBS | _ASKED_SQL)),
    "served_local_rib": (
        _served(lambda s, p: rq.local_rib(s, p, ASKED), flat),
        oracle(study._Q4, "announcements", "roas", "inverse_results", "provider_customers", "peers", extra=study._STUBS | _ASKED_SQL)),
    "served_policy_stats": (_served(lambda s, p: rq.policy_answer(s, p, ASKED)["stats"]), oracle(_STATS, *_ALL, extra=_EXTRA)),
    "served_policy_averages": (_served(lambda s, p: rq.policy_answer(s, p, ASKED)["averages"].withColumns({m: F.round(m, 6) for m in study._METRICS})), oracle(f"select policy, {', '.join(_MEANS)} from ({_STATS}) q group by policy", *_ALL, extra=_EXTRA)),
    "served_policy_hijacks": (_served(lambda s, p: rq.policy_answer(s, p, ASKED, ("rov", "length"))["hijacks"], flat), oracle(f"select * from ({_HELD}) q where policy in ('rov', 'length')", *_ALL, extra=_EXTRA)),
    "write_table": (_write_table, oracle("select event_number, start_time, end_time, origin, url from hijack_events union all select event_number, start_time, end_time, origin, url from hijack_events where end_time is null", "hijack_events")),
    "materialise": (lambda s, d: sinks.materialise(_events(s, d), _new_folder(s)), _E),
    "export_tsv": (_export_tsv, _E),
    "export_pairs_gz": (_export_pairs, oracle("select origin, len, 100 as placeholder from pairs", "pairs")),
    "snapshot": (_snapshot, _E),
    "restore_if_empty": (_restore, _E),
    "continent_lookup": (_continents, "select n_name as country, r_name as continent from nation join region on n_regionkey = r_regionkey"),
}
