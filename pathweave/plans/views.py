"""Routing tables derived from the given tables, in SQL that Spark and the test database both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import prefix as px

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_P = "cast(power(2, 32 - {0}) as bigint)"


def _masked(columns: str, source: str) -> str:
    size = _P.format("len")
    return f"select net0 - (net0 % {size}) as net, cast(len as int) as len, {columns} from ({source}) q"


#: Name -> (tables or views that it needs, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "announcements": ((), _masked(
        "origin, monitor_asn, time",
        "select 8 + (l_partkey % 17) as len, 16777216 + (l_partkey % 512) * 65536 + (l_partkey % 7) * 256 as net0, l_suppkey % 40 as origin, l_suppkey as monitor_asn, l_orderkey as time from lineitem",
    )),
    "roas": ((), _masked(
        "asn, max_length",
        "select 8 + (s_suppkey % 9) as len, 16777216 + (s_suppkey * 5 % 512) * 65536 as net0, s_suppkey % 40 as asn, cast(8 + (s_suppkey % 13) as int) as max_length from supplier",
    )),
    "provider_customers": ((), "select distinct o_custkey % 60 as provider_as, 60 + o_orderkey % 900 as customer_as from orders where o_orderkey % 3 = 0"),
    "peers": ((), "select distinct o_custkey % 60 as peer_as_1, 60 + o_custkey % 40 as peer_as_2 from orders where o_orderkey % 5 = 0"),
    "as_rank": ((), "select cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) * 100 + c_nationkey as bigint) as as_rank, c_custkey as asn from customer"),
    "hijack_events": ((), _masked(
        "event_number, start_time, end_time, origin, url",
        "select 8 + (event_id % 17) as len, 16777216 + (event_id % 512) * 65536 as net0, event_id as event_number, event_id * 10 as start_time, case when event_id % 4 = 0 then null else event_id * 10 + 500 end as end_time, user_id % 40 as origin, concat('/event/', cast(event_id as varchar(20))) as url from events where event_type = 'error'",
    )),
    "hijacks": (("hijack_events",), "select net, len, origin, url from hijack_events where start_time <= 100000 and (end_time is null or end_time >= 20000)"),
    "inverse_results": ((), "select distinct asn, net, len, origin from (" + _masked(
        "asn, origin",
        "select 8 + (l_partkey % 17) as len, 16777216 + (l_partkey % 512) * 65536 + (l_partkey % 7) * 256 as net0, l_suppkey as asn, (l_suppkey * 7) % 40 as origin from lineitem where l_linenumber = 1",
    ) + ") i"),
    "forwarding": ((), "select c_custkey as asn, case when c_custkey < 3 then 64512 + c_custkey else cast(floor(c_custkey / 2) as bigint) end as received_from_asn, c_nationkey % 2 = 0 as implement, 16777216 + (c_custkey % 64) * 65536 as net, cast(16 as int) as len, c_custkey % 7 as origin from customer"),
    "trials": ((), "select l_returnflag as attack_type, l_linestatus as adopt_pol, l_linenumber * 10 as percent, cast(l_quantity as bigint) as hijacked, cast(l_quantity as bigint) + l_partkey % 30 as total, l_partkey % 25 as percent_iter, l_orderkey as trial from lineitem"),
    "dual": ((), "select distinct cast(family as int) as family, cast(case when family = 4 then 0 when len <= 64 then hi0 - hi0 % cast(power(2, 64 - least(len, 63)) as bigint) else hi0 end as bigint) as hi, cast(case when family = 4 then lo0 - lo0 % cast(power(2, 32 - least(len, 32)) as bigint) when len <= 64 then 0 else lo0 - lo0 % cast(power(2, 128 - greatest(len, 68)) as bigint) end as bigint) as net, cast(len as int) as len, origin from (select case when o_orderkey % 2 = 0 then 4 else 6 end as family, case when o_orderkey % 2 = 0 then 8 + (o_custkey + o_orderkey) % 17 else 20 + 8 * (o_orderkey % 10) end as len, 2306124484190404608 + (o_custkey % 4096) * 68719476736 + (o_orderkey % 5) * 1048576 as hi0, case when o_orderkey % 2 = 0 then 16777216 + (o_custkey * 7 % 16384) * 65536 + (o_orderkey % 5) * 256 else o_custkey * 1099511627776 + (o_orderkey % 7) * 65536 end as lo0, o_custkey % 40 as origin from orders) x"),
    "dual_prefixes": (("dual",), "select distinct family, hi, net, len from dual"),
    "dual_roas": (("dual",), "select distinct family, hi, net, len, origin as asn, cast(len + origin % 9 as int) as max_length from dual where len < 40"),
    "trial_attacks": ((), "select s_suppkey as trial, case s_suppkey % 3 when 0 then 'subprefix' when 1 then 'prefix' else 'both' end as attack_type, cast(1 as bigint) as number_of_attackers, cast(3 + s_suppkey % 5 as bigint) as attacker_asn, case s_suppkey % 3 when 0 then '172.20.9.0/24' when 1 then '172.20.0.0/16' else '172.20.0.0/16,172.20.9.0/24' end as attacker_prefixes, cast(11 + s_suppkey % 7 as bigint) as victim, '172.20.0.0/16' as victim_prefixes, case when s_nationkey % 2 = 0 then 'rov' else 'rov_v1' end as adopt_pol, cast((s_suppkey % 4) * 30 as bigint) as percent, cast(s_suppkey % 4 as bigint) as percent_iter, cast(s_nationkey % 2 as bigint) as round_num, cast(s_nationkey % 3 as bigint) as extra_bash_arg_1, case when s_suppkey % 2 = 0 then cast(s_suppkey % 4 as bigint) end as extra_bash_arg_2, cast(null as bigint) as extra_bash_arg_3, cast(null as bigint) as extra_bash_arg_4, cast(null as bigint) as extra_bash_arg_5 from supplier"),
    "trial_forwarding": ((), "select trial, asn, case when asn < 3 then 64512 + asn else cast(floor(asn / 2) as bigint) end as received_from_asn, cast(case when kind in (0, 2) then 2886994176 else 2886991872 end as bigint) as net, cast(case when kind in (0, 2) then 24 else 16 end as int) as len, case kind when 1 then 11 + trial % 7 when 2 then 64512 else 3 + trial % 5 end as origin from (select l_suppkey as trial, l_partkey % 300 as asn, max((l_orderkey + l_linenumber) % 4) as kind from lineitem group by l_suppkey, l_partkey % 300) x"),
    "trial_segments": ((), "select distinct l_suppkey as trial, l_partkey % 330 as asn, case when l_partkey % 330 % 10 = 0 then 'top_100_ases' when l_partkey % 330 % 3 = 0 then 'edge_ases' else 'etc_ases' end as subtable_name, (l_partkey % 330 + l_suppkey) % 3 = 0 as implement from lineitem"),
    "pairs": (("announcements",), "select distinct net, len, origin from announcements"),
    "codes": (("pairs", "roas"), "select d.net, d.len, d.origin, r.asn, r.max_length, r.len as roa_len, r.net as roa_net, case when d.origin <> r.asn and d.len > r.max_length then 4 when d.origin <> r.asn then 3 when d.len > r.max_length then 2 else 0 end as validity from pairs d join roas r on d.len >= r.len and d.net >= r.net and d.net < r.net + " + _P.format("r.len")),
    "known": (("codes",), "select net, len, origin, min(validity) as validity from codes group by net, len, origin"),
    "validity": (("pairs", "known"), "select p.net, p.len, p.origin, coalesce(k.validity, 1) as validity from pairs p left join known k on p.net = k.net and p.len = k.len and p.origin = k.origin"),
    "split": (("validity", "hijacks"), "select v.net, v.len, v.origin, case when validity in (3, 4) then 'asn' when validity = 2 then 'length' end as blocked_by, h.url is not null as hijacked, h.url from validity v left join (select distinct net, len, origin, url from hijacks) h on v.net = h.net and v.len = h.len and v.origin = h.origin"),
    "prefixes": (("announcements",), "select distinct net, cast(len + 2 as int) as len from announcements"),
    "ases": (("provider_customers", "peers"), "select provider_as as asn from provider_customers union select customer_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers"),
    "conn": (("provider_customers", "peers"), "select asn, sum(n) as connectivity from (select provider_as as asn, 1 as n from provider_customers union all select customer_as, 0 from provider_customers union all select peer_as_1, 1 from peers union all select peer_as_2, 1 from peers) c group by asn"),
}


def dependencies(names: tuple[str, ...] | list[str]) -> list[str]:
    """Views in an order in which each stands after those that it needs."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def oracle(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the views that it names, and further ones, as common table expressions."""
    parts = [f"{n} as ({VIEWS[n][1]})" for n in dependencies(names)] + [f"{n} as ({q})" for n, q in (extra or {}).items()]
    recursive = " recursive" if "union" in body and "traced" in (extra or {}) else ""
    return f"with{recursive} {', '.join(parts)} {body}" if parts else body


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; ``net`` and ``len`` become a ``prefix`` struct."""
    for t in TABLES:
        if any(t in VIEWS[n][1] for n in dependencies([name])):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    parts = [f"{n} as ({VIEWS[n][1]})" for n in dependencies([name])[:-1]]
    df = spark.sql((f"with {', '.join(parts)} " if parts else "") + VIEWS[name][1])
    if {"net", "len"} <= set(df.columns):
        family, hi = (F.col("family"), F.col("hi")) if "family" in df.columns else (F.lit(4), F.lit(0))
        p = F.struct(family.cast("tinyint").alias("family"), hi.cast("long").alias("hi"), F.col("net").cast("long").alias("lo"), F.col("len").cast("int").alias("len"))
        df = df.withColumn("prefix", p).drop("family", "hi", "net", "len")
    return df


def flat(df: DataFrame, whole: bool = False) -> DataFrame:
    """Prefix structs as columns ``net`` and ``len``, behind the name's prefix if it is another; ``whole`` adds ``family`` and ``hi``."""
    out = []
    for f in df.schema:
        if f.dataType.simpleString() == px.TYPE:
            stem = "" if f.name == "prefix" else f.name.removesuffix("prefix")
            out += [F.col(f"{f.name}.family").cast("int").alias(f"{stem}family"), F.col(f"{f.name}.hi").alias(f"{stem}hi")] if whole else []
            out += [F.col(f"{f.name}.lo").alias(f"{stem}net"), F.col(f"{f.name}.len").alias(f"{stem}len")]
        else:
            out.append(F.col(f.name))
    return df.select(*out)
