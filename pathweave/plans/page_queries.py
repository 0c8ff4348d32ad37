"""Queries on pages: links of the given web pages, and incident reports that are written as pages from the events and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.plans.views import flat, load, oracle
from pathweave.sources import event_pages as ep
from pathweave.sources import markup

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """List pages, one per origin, with ten rows at their end that are no events, and a page of details for each event."""
    e = load(spark, sf_dir, "hijack_events").withColumn("kind", F.col("event_number") % 3)
    td = lambda content, name="x": F.concat(F.lit(f'\n<td class="{name}">'), content, F.lit("</td>"))
    named = lambda name, asn: F.concat(F.lit(f"{name} &amp; Co, US (AS "), asn.cast("string"), F.lit(")"))
    stamp = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(F.lit(1_500_000_000) + F.col(c)), _STAMP), F.lit(""))
    two = lambda a, b: F.concat(F.lit(f"<i>{a} AS:</i> "), named("ONE", F.col("origin")), F.lit(f"<br/>\n<i>{b} AS:</i>"), named("TWO", F.col("origin") + 1))
    as_info = F.when(F.col("kind") == 0, two("Expected Origin", "Detected Origin")).when(F.col("kind") == 1, two("Origin", "Leaker")).when(F.col("event_number") % 2 == 0, F.lit("N/A")).otherwise(named("NET", F.col("origin")))
    kind = F.when(F.col("kind") == 0, ep.HIJACK).when(F.col("kind") == 1, f"{ep.LEAK} ").otherwise(f"{ep.OUTAGE} ")
    country = F.when(F.col("kind") == 2, F.lit('\n US <img src="us.gif">\n')).otherwise("")
    row = F.concat(F.lit("<tr>"), td(kind, "event_type"), td(country, "country"), td(as_info, "asn"), td(stamp("start_time"), "starttime"), td(stamp("end_time"), "endtime"), td(F.concat(F.lit('<a class="m" href="'), F.col("url"), F.lit('">More detail</a>'))), F.lit("\n</tr>\n"))
    junk = "".join(f"<tr><td>Outage<td>{i}</tr>\n" if i % 2 else f"<tr><th>{i}</th></tr>\n" for i in range(ep.DROP_LAST))
    page = F.concat(F.lit("<html><script>var t = '<tr><td>';</script><table><!-- <tr> -->\n"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit(junk + "</table></html>"))
    lists = e.groupBy("origin").agg(page.alias("html"))
    prefix = px.to_text(F.col("prefix"))
    ended = F.when(F.col("end_time").isNotNull(), td(F.concat(F.lit("End time: "), stamp("end_time")))).otherwise("")
    path = F.concat(F.lit("Detected AS Path "), F.col("origin").cast("string"), F.lit(" 5\n9"))
    peers = td(F.concat(F.lit("Detected by number of BGPMon peers: "), (F.col("origin") + 2).cast("string")))
    hijack = F.concat(td(F.concat(F.lit("Expected prefix: "), prefix)), td(F.lit("x")), td(F.concat(F.lit("Detected prefix: "), prefix)), td(F.lit("x")), td(path), peers)
    told = F.concat(F.lit("Leaked To: <ul><li>7 (SEVEN, &lt;US&gt;)</li>\n<li>"), F.col("origin").cast("string"), F.lit(" (OTHER)</li></ul>"))
    leak = F.concat(td(F.concat(F.lit("Leaked prefix: "), prefix, F.lit(" (AS3 ONE)"))), td(F.lit("x")), td(told), td(F.concat(F.lit("Example AS path: 1 2 "), F.col("origin").cast("string"))), peers)
    outage = td(F.concat(F.lit("Number of Prefixes Affected: "), (F.col("origin") + 3).cast("string"), F.lit(" (7%)")))
    body = F.when(F.col("kind") == 0, hijack).when(F.col("kind") == 1, leak).otherwise(outage)
    details = e.select("url", F.concat(F.lit("<table><tr>"), td(F.concat(F.lit("Start time: "), stamp("start_time"))), ended, body, F.lit("</tr></table>")).alias("html"))
    return lists, details


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, details = _written(spark, sf_dir)
    return ep.with_details(ep.listed_events(lists, ["origin"]), details)


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_time": F.unix_timestamp("start_time"), "end_time": F.unix_timestamp("end_time")})


_TIMES = "1500000000 + start_time as start_time, 1500000000 + end_time as end_time, url"
_TWO = "'ONE & Co, US' as {0}_name, origin as {0}_number, 'TWO & Co, US' as {1}_name, origin + 1 as {1}_number"

QUERIES = {
    "page_links": (
        lambda s, d: markup.table_rows(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), ["page_id"], row="ul", cell="li").select("page_id", "nth", F.posexplode("cells").alias("place", "cell"))
        .select("page_id", "nth", "place", F.array_join("cell.strings", " ").alias("text"), F.get("cell.links", F.lit(0)).alias("link")),
        "select page_id, 0 as nth, unnest(range(len(a)))::int as place, trim(regexp_replace(replace(replace(unnest(t), '&amp;', '&'), '&quot;', '\"'), '\\s+', ' ', 'g')) as text, nullif(replace(unnest(a), '&amp;', '&'), '') as link from (select page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) as a, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) as t from pages) x"),
    "page_events": (
        lambda s, d: _timed(_events(s, d)).select("origin", F.trim("event_type").alias("event_type"), "country", F.array_join("as_info", "|").alias("as_info"), "start_time", "end_time", "url", "event_number", F.size("details").alias("n_details")),
        oracle("select origin, case event_number % 3 when 0 then 'Possible Hijack' when 1 then 'BGP Leak' else 'Outage' end as event_type, case when event_number % 3 = 2 then 'US' end as country, case when event_number % 3 = 0 then 'Expected Origin AS:|ONE & Co, US (AS ' || origin || ')|Detected Origin AS:|TWO & Co, US (AS ' || origin + 1 || ')' when event_number % 3 = 1 then 'Origin AS:|ONE & Co, US (AS ' || origin || ')|Leaker AS:|TWO & Co, US (AS ' || origin + 1 || ')' when event_number % 2 = 0 then 'N/A' else 'NET & Co, US (AS ' || origin || ')' end as as_info, " + _TIMES + ", event_number, (1 + (end_time is not null)::int + case event_number % 3 when 0 then 6 when 1 then 5 else 1 end)::int as n_details from hijack_events", "hijack_events")),
    "page_hijacks": (
        lambda s, d: flat(_timed(ep.hijacks(_events(s, d)))).withColumn("detected_as_path", F.array_join("detected_as_path", ",")),
        oracle("select event_number, cast(null as varchar) as country, " + _TIMES + ", " + _TWO.format("expected_origin", "detected_origin") + ", net as expected_net, len as expected_len, net as more_specific_net, len as more_specific_len, concat(origin, ',5,9') as detected_as_path, cast(origin + 2 as int) as detected_by_bgpmon_peers from hijack_events where event_number % 3 = 0", "hijack_events")),
    "page_leaks": (
        lambda s, d: flat(_timed(ep.leaks(_events(s, d)))).withColumns({c: F.array_join(c, ",") for c in ("leaked_to_name", "leaked_to_number", "example_as_path")}),
        oracle("select event_number, cast(null as varchar) as country, " + _TIMES + ", " + _TWO.format("origin_as", "leaker_as") + ", net as leaked_net, len as leaked_len, 'SEVEN, <US>,OTHER' as leaked_to_name, concat('7,', origin) as leaked_to_number, concat('1,2,', origin) as example_as_path, cast(origin + 2 as int) as detected_by_bgpmon_peers from hijack_events where event_number % 3 = 1", "hijack_events")),
    "page_outages": (
        lambda s, d: _timed(ep.outages(_events(s, d))).withColumn("percent_prefixes_affected", F.col("percent_prefixes_affected").cast("int")),
        oracle("select event_number, 'US' as country, " + _TIMES + ", case when event_number % 2 = 1 then 'NET & Co, US' end as as_name, case when event_number % 2 = 1 then origin end as as_number, cast(origin + 3 as int) as number_prefixes_affected, 7 as percent_prefixes_affected from hijack_events where event_number % 3 = 2", "hijack_events")),
}
