"""Queries on the parsers of text, JSON and HTML: their input lines are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.scalars import parse_as_info
from pathweave.operators.events import union_all
from pathweave.plans.views import flat, load, oracle
from pathweave.sources import text as tx


def _q(run, sql=None):
    return run, sql


def _text(p):
    return px.to_text(p)


def _lines(s, d, *parts):
    """Announcements as text lines; the path is the monitor, a middle AS and the origin."""
    ann = load(s, d, "announcements")
    return ann.select(F.concat_ws("|", *[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value"))




def _path():
    return F.concat_ws(" ", F.col("monitor_asn"), F.when(F.col("origin") == 7, F.lit("{1,2}")).otherwise(F.lit("3")), F.col("origin"))


def _rib(s, d):
    return _lines(s, d, "=", _text(F.col("prefix")), _path(), "10.0.0.1", "i", "", "", "1:2", "10.0.0.1", F.col("time"), "1")


def _dump(s, d):
    return _lines(s, d, "TABLE_DUMP1", F.col("time"), "B", "10.0.0.1", "77", _text(F.col("prefix")), _path(), "IGP")


def _ann_out(df):
    return flat(df).withColumn("as_path", F.array_join("as_path", " "))


def _rel_lines(s, d):
    pc = load(s, d, "provider_customers").select(F.concat_ws("|", "provider_as", "customer_as", F.lit("-1")).alias("value"))
    peers = load(s, d, "peers").select(F.concat_ws("|", "peer_as_1", "peer_as_2", F.lit("0"), F.lit("bgp")).alias("value"))
    note = load(s, d, "peers").select(F.concat(F.lit("# "), F.col("peer_as_1")).alias("value"))
    return pc.unionByName(peers).unionByName(note)


def _roa_json(s, d):
    r = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("AS"), F.col("asn")).alias("asn"), _text(F.col("prefix")).alias("prefix"), F.col("max_length").alias("maxLength"), F.lit("ta").alias("ta"))).alias("roas")))
    return load(s, d, "roas").select(r.alias("value"))


def _historical(s, d):
    line = F.concat_ws(",", F.lit("uri"), F.concat(F.lit("AS"), F.col("asn")), _text(F.col("prefix")), F.col("max_length"), F.concat(F.lit("2015-03-0"), F.col("asn") % 9 + 1, F.lit(" 04:05:06")), F.when(F.col("asn") % 2 == 0, F.concat(F.lit("201"), F.col("asn") % 10, F.lit("-02-03 04:05:06"))).otherwise(""))
    return load(s, d, "roas").select(line.alias("value"), F.concat(F.lit("/a/2019/08/0"), F.col("asn") % 9 + 1, F.lit("/roas.csv")).alias("file"))


def _rank_pages(s, d):
    """One table page per nation with its customers as rows."""
    c = s.read.parquet(f"{d}/customer.parquet")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("c_custkey").cast("string")), cell(F.concat(F.lit("<a>"), (F.col("c_custkey") * 3).cast("string"), F.lit("</a>"))), cell(F.when(F.col("c_custkey") % 5 == 0, "unknown").otherwise(F.col("c_name"))), cell(F.concat(F.lit('<span class="flag-icon flag-icon-'), F.lower(F.chr(F.lit(65).cast("long") + F.col("c_nationkey"))), F.lit('a"></span>'))), cell(F.format_number(F.col("c_custkey") * 11, 0)), F.lit("</tr>"))
    return c.groupBy("c_nationkey").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))


def _event_pages(s, d):
    """Event rows with four detail cells, one page per origin; the last row of a page is malformed."""
    e = load(s, d, "hijack_events")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1500000000) + F.col("start_time")), "yyyy-MM-dd HH:mm:ss")
    row = F.concat(F.lit("<tr>"), cell(F.lit("Possible Hijack")), cell(F.lit("US")), cell(F.concat(F.lit("Expected Origin AS: ONE (AS "), F.col("origin"), F.lit(") Detected Origin AS: TWO (AS "), F.col("origin") + 1, F.lit(")"))), cell(stamp), cell(F.lit("")), cell(F.concat(F.lit('<a href="'), F.col("url"), F.lit('">More</a>'))),
                   cell(F.concat(F.lit("Expected prefix: "), _text(F.col("prefix")))), cell(F.lit("x")), cell(F.concat(F.lit("Detected advertisement: "), _text(F.col("prefix")))), cell(F.lit("x")), cell(F.concat(F.lit("Detected AS Path "), F.col("origin"), F.lit(" 5 9"))), cell(F.concat(F.lit("Detected by number of BGPMon peers: "), F.col("origin") + 2)), F.lit("</tr>"))
    return e.groupBy("origin").agg(F.concat(F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("<tr><td>broken</td></tr>")).alias("html"))


def _info(s, d):
    n = F.col("c_custkey")
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(n % 4 == 0, F.concat(F.lit("NAME (AS "), n, F.lit(")"))).when(n % 4 == 1, F.concat(n, F.lit(" ... (NAME)"))).when(n % 4 == 2, n.cast("string")).otherwise("N/A").alias("info"))


def _black(s, d):
    return load(s, d, "roas").select(F.concat(_text(F.col("prefix")), F.lit(" AS1 text AS"), F.col("asn")).alias("value"))


def _probes(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    n = F.col("c_custkey")
    return c.select(F.concat_ws("\t", n, F.concat(F.lit("AS"), n % 50), F.lit("US"), F.when(n % 3 == 0, "Connected").otherwise("Abandoned"), F.concat(F.lit("10."), n % 250, F.lit(".0.0/16")), F.when(n % 2 == 0, "✓").otherwise("✗"), F.lit("None"), F.lit("✗")).alias("value"))


def _traces(s, d):
    n = F.col("o_orderkey")
    hop = lambda h: F.struct(F.lit(h).alias("hop"), F.array(F.struct(F.concat(F.lit("10.0.0."), (n + h) % 200).alias("from")), F.struct(F.when(n % 2 == 0, F.concat(F.lit("10.1.0."), n % 200)).alias("from"))).alias("result"))
    doc = F.to_json(F.array(F.struct(F.array(hop(2), hop(1)).alias("result"))))
    return s.read.parquet(f"{d}/orders.parquet").select(n.cast("string").alias("trace_id"), doc.alias("value"))


def _rank_json(s, d):
    r = load(s, d, "as_rank")
    page = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.struct(F.col("as_rank").alias("rank"), F.col("asn").cast("string").alias("asn"), F.concat(F.lit("N"), F.col("asn")).alias("asnName")).alias("node"))).alias("edges")).alias("asns")).alias("data")))
    link = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.struct(F.struct(F.col("provider_as").cast("string").alias("asn")).alias("asn0"), F.struct(F.col("customer_as").cast("string").alias("asn")).alias("asn1")).alias("node"))).alias("edges")).alias("asnLinks")).alias("data")))
    return r.select(page.alias("value")), load(s, d, "provider_customers").select(F.col("provider_as").cast("string").alias("asn"), link.alias("value"))


_HEADER = "select net, len, concat(monitor_asn, ' 3 ', origin) as as_path, origin, time from announcements where origin <> 7"

QUERIES = {
    "parse_rib_lines": _q(lambda s, d: _ann_out(tx.parse_rib_lines(_rib(s, d))), oracle(_HEADER, "announcements")),
    "parse_dump_lines": _q(lambda s, d: _ann_out(tx.parse_dump_lines(_dump(s, d))), oracle(_HEADER, "announcements")),
    "parse_update_lines": _q(lambda s, d: _ann_out(tx.parse_update_lines(_rib(s, d), 100, 200)), oracle("select net, len, concat(monitor_asn, ' 3 ', origin) as as_path, origin, time, '=' as update_type, 100 as interval_start, 200 as interval_end from announcements where origin <> 7", "announcements")),
    "parse_providers": _q(lambda s, d: tx.parse_relationships(_rel_lines(s, d))[0], oracle("select provider_as, customer_as from provider_customers", "provider_customers")),
    "parse_peers": _q(lambda s, d: tx.parse_relationships(_rel_lines(s, d))[1], oracle("select peer_as_1, peer_as_2 from peers", "peers")),
    "parse_roas_json": _q(lambda s, d: flat(tx.parse_roas_json(_roa_json(s, d), 1600000000)), oracle("select asn, net, len, max_length, 1600000000 as created_at from roas", "roas")),
    "parse_historical_roas": _q(lambda s, d: flat(tx.parse_historical_roas(_historical(s, d))).select("asn", "net", "len", F.col("maxlen").cast("int").alias("maxlen"), F.col("date_added").cast("string").alias("date_added"), F.col("notbefore").cast("string").alias("notbefore"), F.col("notafter").cast("string").alias("notafter")), oracle("select asn, net, len, max_length as maxlen, concat('2019-08-0', asn % 9 + 1) as date_added, concat('2015-03-0', asn % 9 + 1, ' 04:05:06') as notbefore, case when asn % 2 = 0 then concat('201', asn % 10, '-02-03 04:05:06') end as notafter from roas", "roas")),
    "parse_validity_json": _q(
        lambda s, d: flat(tx.parse_validity_json(load(s, d, "roas").select(F.to_json(F.struct(F.concat(F.lit("AS"), F.col("asn")).alias("asn"), _text(F.col("prefix")).alias("prefix"), F.when(F.col("asn") % 2 == 0, "VALID").otherwise("INVALID_BY_ALL").alias("validity"))).alias("value")))).withColumn("validity", F.col("validity").cast("int")),
        oracle("select asn as origin, net, len, case when asn % 2 = 0 then 0 else 4 end as validity from roas", "roas")),
    "extract_rank_rows": _q(lambda s, d: tx.extract_rank_rows(_rank_pages(s, d)), "select c_custkey as as_rank, c_custkey * 3 as asn, case when c_custkey % 5 <> 0 then c_name end as organization, chr((65 + c_nationkey)::int) || 'A' as country, (c_custkey * 11)::int as cone_size from customer"),
    "parse_rank_json": _q(lambda s, d: tx.parse_rank_json(*_rank_json(s, d)).withColumn("links", F.array_join("links", ",")), oracle("select as_rank as rank, asn, concat('N', asn) as organization, coalesce(l, '') as links from as_rank left join (select provider_as, string_agg(cast(customer_as as varchar), ',' order by customer_as) as l from provider_customers group by provider_as) p on provider_as = asn", "as_rank", "provider_customers")),
    "extract_event_rows": _q(lambda s, d: tx.extract_event_rows(_event_pages(s, d), drop_last=1).select("event_type", "country", "url", "event_number", F.unix_timestamp("start_time").alias("start"), F.col("end_time").isNull().alias("open")), oracle("select 'Possible Hijack' as event_type, 'US' as country, url, cast(event_number as int) as event_number, 1500000000 + start_time as start, true as open from hijack_events", "hijack_events")),
    "hijack_details": _q(
        lambda s, d: flat(tx.hijack_details(tx.extract_event_rows(_event_pages(s, d), drop_last=1)).select("event_number", "expected_origin_name", "expected_origin_number", "detected_origin_name", "detected_origin_number", F.col("expected_prefix").alias("prefix"), "more_specific_prefix", F.array_join("detected_as_path", ",").alias("detected_as_path"), "detected_by_bgpmon_peers")),
        oracle("select cast(event_number as int) as event_number, 'ONE' as expected_origin_name, origin as expected_origin_number, 'TWO' as detected_origin_name, origin + 1 as detected_origin_number, net, len, net as more_specific_net, len as more_specific_len, concat(origin, ',5,9') as detected_as_path, cast(origin + 2 as int) as detected_by_bgpmon_peers from hijack_events", "hijack_events")),
    "leak_details": _q(
        lambda s, d: flat(tx.leak_details(load(s, d, "hijack_events").select("event_number", F.concat(F.lit("Origin AS: ONE (AS "), F.col("origin"), F.lit(") Leaker AS: TWO (AS 9)")).alias("as_info"), F.array(F.concat(F.lit("Leaked prefix: "), _text(F.col("prefix"))), F.lit("x"), F.concat(F.lit("<li>A (AS 1)</li><li>B (AS "), F.col("origin"), F.lit(")</li>")), F.concat(F.lit("Path: 1 2 "), F.col("origin")), F.lit("peers 8")).alias("cells"))).select("event_number", "origin_as_name", "origin_as_number", "leaker_as_name", "leaker_as_number", F.col("leaked_prefix").alias("prefix"), F.array_join("leaked_to_name", ",").alias("to_name"), F.array_join("leaked_to_number", ",").alias("to_number"), F.array_join("example_as_path", ",").alias("path"), "detected_by_bgpmon_peers")),
        oracle("select event_number, 'ONE' as origin_as_name, origin as origin_as_number, 'TWO' as leaker_as_name, 9 as leaker_as_number, net, len, 'A,B' as to_name, concat('1,', origin) as to_number, concat('1,2,', origin) as path, 8 as detected_by_bgpmon_peers from hijack_events", "hijack_events")),
    "outage_details": _q(
        lambda s, d: tx.outage_details(load(s, d, "hijack_events").select("event_number", F.concat(F.lit("NET (AS "), F.col("origin"), F.lit(")")).alias("as_info"), F.array(F.concat(F.lit("Number of Prefixes Affected: "), F.col("origin") + 3, F.lit(" (7%)"))).alias("cells"))).select("event_number", "as_name", "as_number", "number_prefixes_affected", F.col("percent_prefixes_affected").cast("int").alias("percent_prefixes_affected")),
        oracle("select event_number, 'NET' as as_name, origin as as_number, cast(origin + 3 as int) as number_prefixes_affected, 7 as percent_prefixes_affected from hijack_events", "hijack_events")),
    "parse_as_info": _q(lambda s, d: _info(s, d).select("c_custkey", parse_as_info(F.col("info")).alias("i")).select("c_custkey", "i.name", "i.number"), "select c_custkey, case when c_custkey % 4 < 2 then 'NAME' end as name, case when c_custkey % 4 < 3 then c_custkey end as number from customer"),
    "blacklist_asn": _q(lambda s, d: tx.extract_blacklist(_black(s, d), "asn", "list").select("asn", "source"), oracle("select asn, 'list' as source from roas union select 1, 'list'", "roas")),
    "blacklist_cidr": _q(lambda s, d: flat(tx.extract_blacklist(_black(s, d), "cidr", "list")).select("net", "len", "source"), oracle("select distinct net, len, 'list' as source from roas", "roas")),
    "blacklist_multi": _q(lambda s, d: flat(tx.extract_blacklist(_black(s, d), "multi", "list")), oracle("select distinct asn, net, len, 'list' as source from roas", "roas")),
    "blacklist_ip": _q(lambda s, d: flat(tx.extract_blacklist(load(s, d, "roas").select(F.concat(F.lit("host "), F.split_part(_text(F.col("prefix")), F.lit("/"), F.lit(1)), F.lit(" and 1.2.3.0/24")).alias("value")), "ip", "list")).select("net", "len", "source"), oracle("select distinct net, 32 as len, 'list' as source from roas", "roas")),
    "all_blacklists": _q(lambda s, d: flat(union_all(tx.extract_blacklist(_black(s, d), "asn", "one"), tx.extract_blacklist(_black(s, d), "multi", "two"))), oracle("select asn, cast(null as bigint) as net, cast(null as int) as len, 'one' as source from (select asn from roas union select 1) a union all select distinct asn, net, len, 'two' from roas", "roas")),
    "serial_hijackers": _q(lambda s, d: tx.parse_serial_hijackers(load(s, d, "as_rank").select(F.col("asn").alias("ASN"), (F.col("asn") % 3).alias("HardVotePred"))), oracle("select asn from as_rank where asn % 3 = 1", "as_rank")),
    "parse_cdn_lines": _q(lambda s, d: tx.parse_cdn_lines(load(s, d, "as_rank").select(F.concat(F.lit('"'), F.col("asn"), F.lit('","NAME, Inc., US"')).alias("value"), F.lit("cdn").alias("cdn"))), oracle("select 'cdn' as cdn, asn from as_rank", "as_rank")),
    "parse_probes": _q(lambda s, d: flat(tx.parse_probes(_probes(s, d))), "select c_custkey as probe_id, c_custkey % 50 as asn, 'US' as country, true as connected, (10 * 256 + c_custkey % 250) * 65536 as net, 16 as len, c_custkey % 2 = 0 as public, null::varchar as address_v4, false as anchor from customer where c_custkey % 3 = 0"),
    "parse_traceroutes": _q(lambda s, d: tx.parse_traceroutes(_traces(s, d)).select("trace_id", "packet", F.array_join("path", ",", "-").alias("path")), "select o_orderkey::varchar as trace_id, p as packet, case when p = 0 then concat('10.0.0.', (o_orderkey + 1) % 200, ',10.0.0.', (o_orderkey + 2) % 200) when o_orderkey % 2 = 0 then concat('10.1.0.', o_orderkey % 200, ',10.1.0.', o_orderkey % 200) else '-,-' end as path from orders, (select unnest([0, 1]) as p) x"),
    "select_dumps": _q(lambda s, d: tx.select_dumps(load(s, d, "hijack_events").select(F.when(F.col("origin") % 2 == 0, "a").otherwise("b").alias("source"), F.when(F.col("origin") % 3 == 0, "rib").otherwise("updates").alias("dump_type"), F.col("start_time").alias("time"), "url"), ["a"], ["rib"], 1000, 100000), oracle("select 'a' as source, 'rib' as dump_type, start_time as time, url from hijack_events where origin % 6 = 0 and start_time between 1000 and 100000", "hijack_events")),
    "prefix_text": _q(lambda s, d: load(s, d, "prefixes").select(_text(F.col("prefix")).alias("text"), px.parse(_text(F.col("prefix")))["lo"].alias("net")), oracle("select concat(net // 16777216, '.', net // 65536 % 256, '.', net // 256 % 256, '.', net % 256, '/', len) as text, net from prefixes", "prefixes")),
}
