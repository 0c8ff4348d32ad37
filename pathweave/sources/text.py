"""Readers of routing data sets from text, JSON and HTML files.

Each reader is a thin ``read_*`` around a ``parse_*`` that works on a DataFrame of lines (``value``) or pages, so files,
streams and tables are parsed alike. Malformed rows drop out, as do rows without a prefix or origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.scalars import digits, parse_as_info, validity_code


def _nth(fields: Column, n: int) -> Column:
    """A field, or null where a line has fewer: conditions may be evaluated in any order, so none guards an index."""
    return F.get(fields, F.lit(n))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _path(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("long"))


def _announcement(rows: DataFrame, prefix: Column, path: Column, time: Column, *extra: Column) -> DataFrame:
    out = rows.select(px.parse(prefix).alias("prefix"), _path(path).alias("as_path"), time.try_cast("double").cast("long").alias("time"), *extra)
    out = out.withColumn("origin", F.element_at(F.nullif("as_path", F.array().cast("array<bigint>")), -1))
    return out.where("prefix is not null and origin is not null")


def parse_rib_lines(df: DataFrame) -> DataFrame:
    """``TYPE|PREFIX|AS_PATH|...|TIMESTAMP|...`` with 11 fields; types ``= + -``; lines with AS sets drop out."""
    f = F.split("value", "[|]", -1)
    rows = df.where(F.col("value").rlike("^[=+-][|]") & ~F.contains("value", F.lit("{")) & (F.size(f) >= 10))
    return _announcement(rows, _nth(f, 1), _nth(f, 2), _nth(f, 9)).select("prefix", "as_path", "origin", "time")


def read_rib_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_rib_lines(lines(spark, path))


def parse_dump_lines(df: DataFrame) -> DataFrame:
    """``FORMAT|TIME|KIND|PEER|PEER_AS|PREFIX|AS_PATH|...``; lines with AS sets drop out."""
    f = F.split("value", "[|]", -1)
    rows = df.where(~F.contains("value", F.lit("{")) & (F.size(f) >= 7))
    return _announcement(rows, _nth(f, 5), _nth(f, 6), _nth(f, 1)).select("prefix", "as_path", "origin", "time")


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_dump_lines(lines(spark, path))


def parse_update_lines(df: DataFrame, start: int, end: int) -> DataFrame:
    """RIB lines with their type and the interval that they were taken in."""
    f = F.split("value", "[|]", -1)
    rows = df.where(F.col("value").rlike("^[=+-][|]") & ~F.contains("value", F.lit("{")) & (F.size(f) >= 10))
    out = _announcement(rows, _nth(f, 1), _nth(f, 2), _nth(f, 9), _nth(f, 0).alias("update_type"))
    return out.withColumns({"interval_start": F.lit(start).cast("long"), "interval_end": F.lit(end).cast("long")}).select("interval_end", "interval_start", "time", "origin", "prefix", "as_path", "update_type")


def read_update_lines(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    return parse_update_lines(lines(spark, path), start, end)


def parse_relationships(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a|b|-1`` are providers and customers, ``a|b|0`` peers; lines with ``#`` are comments."""
    f = F.split("value", "[|]")
    rows = df.where(~F.startswith(F.col("value"), F.lit("#"))).select(_nth(f, 0).try_cast("long").alias("a"), _nth(f, 1).try_cast("long").alias("b"), F.get(f, F.lit(2)).alias("kind")).where("a is not null and b is not null")
    pc = rows.where("kind = '-1'").select(F.col("a").alias("provider_as"), F.col("b").alias("customer_as"))
    return pc, rows.where("kind = '0'").select(F.col("a").alias("peer_as_1"), F.col("b").alias("peer_as_2"))


def read_relationships(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_relationships(lines(spark, path))


ROA_JSON = "struct<roas:array<struct<asn:string,prefix:string,maxLength:int,ta:string>>>"


def parse_roas_json(df: DataFrame, created_at: int) -> DataFrame:
    """Documents ``{"roas": [{asn, prefix, maxLength, ta}]}``, one per row of ``value``."""
    rows = df.select(F.explode(F.from_json("value", ROA_JSON)["roas"]).alias("r"))
    return rows.select(digits(F.col("r.asn")).alias("asn"), px.parse(F.col("r.prefix")).alias("prefix"), F.col("r.maxLength").alias("max_length"), F.lit(created_at).cast("long").alias("created_at")).where("prefix is not null")


def read_roas_json(spark: SparkSession, path: str, created_at: int) -> DataFrame:
    return parse_roas_json(spark.read.text(path, wholetext=True), created_at)


def parse_historical_roas(df: DataFrame) -> DataFrame:
    """Lines ``uri,AS..,prefix,maxlen,notbefore,notafter`` with ``file``, whose path holds the day as ``yyyy/mm/dd``. Times and days that
    are empty or none are null."""
    f = F.split("value", ",", -1)
    day = F.translate(F.regexp_extract("file", "([0-9]{4}/[0-9]{2}/[0-9]{2})", 1), "/", "-").try_cast("date")
    rows = df.where((F.size(f) >= 6) & _nth(f, 1).rlike("^AS[0-9]+$"))
    return rows.select(
        digits(_nth(f, 1)).alias("asn"), px.parse(_nth(f, 2)).alias("prefix"), F.coalesce(_nth(f, 3).try_cast("short"), px.parse(_nth(f, 2))["len"].cast("short")).alias("maxlen"),
        F.trim(_nth(f, 4)).try_cast("timestamp_ntz").alias("notbefore"), F.trim(_nth(f, 5)).try_cast("timestamp_ntz").alias("notafter"), day.alias("date_added"),
    ).where("prefix is not null")


def read_historical_roas(spark: SparkSession, glob: str) -> DataFrame:
    return parse_historical_roas(spark.read.text(glob).withColumn("file", F.col("_metadata.file_path")))


def parse_validity_json(df: DataFrame) -> DataFrame:
    """Objects ``{"asn": "AS1", "prefix": ..., "validity": NAME}``, one a row; names become codes."""
    r = F.from_json("value", "struct<asn:string,prefix:string,validity:string>")
    return df.select(digits(r["asn"]).alias("origin"), px.parse(r["prefix"]).alias("prefix"), validity_code(r["validity"]).alias("validity")).where("prefix is not null")


def read_validity_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_validity_json(lines(spark, path))


def _inside(tag: str) -> Column:
    """Pattern of an element: group 1 runs to the first closing tag. It takes texts and other tags as wholes and never goes back."""
    return F.lit(rf"(?i)<{tag}\b[^>]*>((?:[^<]++|<(?!/{tag}>))*+)</{tag}>")


def table_rows(pages: DataFrame, html: str = "html", row: str = "tr", cell: str = "td", drop_last: int = 0) -> DataFrame:
    """Rows of HTML tables as arrays of cells: adds ``nth`` and ``cells`` (inner HTML). The last ``drop_last`` rows of a page drop out."""
    whole = pages.withColumn("_rows", F.regexp_extract_all(html, _inside(row), F.lit(1)))
    # Cut inside the page, so that no row needs its page to know how far from the end it is.
    kept = F.slice("_rows", F.lit(1), F.greatest(F.size("_rows") - drop_last, F.lit(0))) if drop_last else F.col("_rows")
    found = whole.select(*pages.columns, F.posexplode(kept).alias("nth", "_row"))
    # An array of one element, so cells are found once a row, also where a filter looks at them.
    return found.withColumn("cells", F.explode(F.array(F.regexp_extract_all("_row", _inside(cell), F.lit(1))))).drop("_row")


def inner_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def extract_rank_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """AS-rank table rows of five cells; the country comes from a flag class, an unknown organisation is null."""
    c = F.col("cells")
    rows = table_rows(pages, html).where(F.size("cells") == 5)
    organization = F.when(F.lower(inner_text(_nth(c, 2))) != "unknown", F.nullif(inner_text(_nth(c, 2)), F.lit("")))
    country = F.upper(F.nullif(F.regexp_extract(_nth(c, 3), "flag-icon-([a-z]{2})", 1), F.lit("")))
    return rows.select(
        digits(inner_text(_nth(c, 0))).alias("as_rank"), digits(inner_text(_nth(c, 1))).alias("asn"), organization.alias("organization"), country.alias("country"), digits(F.translate(inner_text(_nth(c, 4)), ",", "")).cast("int").alias("cone_size")
    ).where("asn is not null")


RANK_ASNS = "struct<data:struct<asns:struct<edges:array<struct<node:struct<rank:bigint,asn:string,asnName:string>>>>>>"
RANK_LINKS = "struct<data:struct<asnLinks:struct<edges:array<struct<node:struct<asn0:struct<asn:string>,asn1:struct<asn:string>>>>>>>"


def parse_rank_json(asns: DataFrame, links: DataFrame) -> DataFrame:
    """AS-rank pages and link pages (``asn, value``): rank, asn, organization, links (empty without any)."""
    node = asns.select(F.explode(F.from_json("value", RANK_ASNS)["data"]["asns"]["edges"]).alias("e")).select("e.node.*")
    edges = links.select("asn", F.explode(F.from_json("value", RANK_LINKS)["data"]["asnLinks"]["edges"]).alias("e"))
    gathered = edges.groupBy(F.col("asn").cast("long").alias("asn")).agg(F.array_sort(F.collect_set(F.col("e.node.asn1.asn").cast("long"))).alias("links"))
    rank = node.select("rank", F.col("asn").cast("long").alias("asn"), F.col("asnName").alias("organization"))
    return rank.join(gathered, "asn", "left").select("rank", "asn", "organization", F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))


def read_rank_json(spark: SparkSession, asns: str, links: str) -> DataFrame:
    """Link files carry the AS in their name: ``.../<asn>.json``."""
    pages = spark.read.text(links, wholetext=True).withColumn("asn", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)\.json$", 1))
    return parse_rank_json(spark.read.text(asns, wholetext=True), pages)


def extract_event_rows(pages: DataFrame, html: str = "html", drop_last: int = 10) -> DataFrame:
    """Event list rows: type, country, AS text, start, end, url and number, and all ``cells``; the last malformed rows of a page drop out."""
    c = F.col("cells")
    kept = table_rows(pages, html, drop_last=drop_last).where(F.size("cells") >= 6)
    time = lambda x: F.try_to_timestamp(F.concat(F.nullif(inner_text(x), F.lit("")), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    url = F.regexp_extract(_nth(c, 5), r'href="([^"]+)"', 1)
    return kept.select(
        inner_text(_nth(c, 0)).alias("event_type"), F.nullif(F.regexp_extract(inner_text(_nth(c, 1)), r"\b([A-Z]{2})\b", 1), F.lit("")).alias("country"), inner_text(_nth(c, 2)).alias("as_info"),
        time(_nth(c, 3)).alias("start_time"), time(_nth(c, 4)).alias("end_time"), F.nullif(url, F.lit("")).alias("url"), digits(url).cast("int").alias("event_number"), "cells",
    )


def hijack_details(rows: DataFrame, cells: str = "cells", info: str = "as_info") -> DataFrame:
    """Expected and detected AS, prefixes, detected path and peers; detail cells count from the end."""
    at = lambda n: inner_text(F.try_element_at(cells, F.lit(-n)))
    who = lambda label: parse_as_info(F.trim(F.regexp_extract(info, rf"{label} AS:?\s*(.*?)(?:Detected AS|$)", 1)))
    prefix = r"([0-9a-fA-F.:]+/[0-9]+)"
    return rows.withColumns({
        "expected_origin_name": who("Expected Origin")["name"], "expected_origin_number": who("Expected Origin")["number"],
        "detected_origin_name": parse_as_info(F.regexp_extract(info, r"Detected Origin AS:?\s*(.*)$", 1))["name"], "detected_origin_number": parse_as_info(F.regexp_extract(info, r"Detected Origin AS:?\s*(.*)$", 1))["number"],
        "expected_prefix": px.parse(F.regexp_extract(at(6), prefix, 1)), "more_specific_prefix": px.parse(F.regexp_extract(at(4), prefix, 1)),
        "detected_as_path": F.transform(F.regexp_extract_all(at(2), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long")), "detected_by_bgpmon_peers": digits(at(1)).cast("int"),
    })


def leak_details(rows: DataFrame, cells: str = "cells", info: str = "as_info") -> DataFrame:
    """Origin and leaker AS, leaked prefix, whom it leaked to, an example path and peers."""
    at = lambda n: inner_text(F.try_element_at(cells, F.lit(-n)))
    origin = parse_as_info(F.regexp_extract(info, r"Origin AS:?\s*(.*?)(?:Leaker AS|$)", 1))
    leaker = parse_as_info(F.regexp_extract(info, r"Leaker AS:?\s*(.*)$", 1))
    to = F.transform(F.split(F.try_element_at(cells, F.lit(-3)), r"(?i)<br\s*/?>|</li>"), lambda x: parse_as_info(inner_text(x)))
    to = F.filter(to, lambda x: x["number"].isNotNull())
    return rows.withColumns({
        "origin_as_name": origin["name"], "origin_as_number": origin["number"], "leaker_as_name": leaker["name"], "leaker_as_number": leaker["number"],
        "leaked_prefix": px.parse(F.regexp_extract(at(5), r"([0-9a-fA-F.:]+/[0-9]+)", 1)), "leaked_to_name": F.transform(to, lambda x: x["name"]), "leaked_to_number": F.transform(to, lambda x: x["number"]),
        "example_as_path": F.transform(F.regexp_extract_all(at(2), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long")), "detected_by_bgpmon_peers": digits(at(1)).cast("int"),
    })


def outage_details(rows: DataFrame, cells: str = "cells", info: str = "as_info") -> DataFrame:
    """AS, and number and percent of its prefixes that are affected."""
    text = inner_text(F.try_element_at(cells, F.lit(-1)))
    who = parse_as_info(F.col(info))
    return rows.withColumns({
        "as_name": who["name"], "as_number": who["number"], "number_prefixes_affected": digits(text).cast("int"),
        "percent_prefixes_affected": F.regexp_extract(text, r"\(?([0-9]+)\s*%", 1).try_cast("short"),
    })


BLACKLIST_MODES = ("asn", "ip", "cidr", "multi")


def extract_blacklist(df: DataFrame, mode: str, source: str) -> DataFrame:
    """Distinct entries of blacklist lines: AS numbers, bare addresses, CIDR blocks, or lines with both block and AS."""
    if mode not in BLACKLIST_MODES:
        raise ValueError(f"mode is one of {', '.join(BLACKLIST_MODES)}")
    null_asn, null_prefix = F.lit(None).cast("long"), F.lit(None).cast(px.TYPE)
    if mode == "asn":
        found = df.select(F.explode(F.regexp_extract_all("value", F.lit(r"AS([0-9]+)"), F.lit(1))).alias("x"))
        rows = found.select(F.col("x").try_cast("long").alias("asn"), null_prefix.alias("prefix")).where("asn is not null")
    elif mode == "multi":
        block = px.parse(F.regexp_extract("value", r"^((?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2})", 1))
        asn = F.try_element_at(F.regexp_extract_all("value", F.lit(r"AS([0-9]+)"), F.lit(1)), F.lit(-1)).cast("long")
        rows = df.select(asn.alias("asn"), block.alias("prefix")).where("asn is not null and prefix is not null")
    else:
        pattern = r"(?<![0-9./])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9./])" if mode == "ip" else r"((?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2})"
        found = df.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("x"))
        rows = found.select(null_asn.alias("asn"), px.parse(F.col("x")).alias("prefix")).where("prefix is not null")
    return rows.distinct().withColumn("source", F.lit(source))


def parse_serial_hijackers(df: DataFrame) -> DataFrame:
    """Rows with ``ASN`` and ``HardVotePred``: the ASes that the vote calls hijackers."""
    return df.where(F.col("HardVotePred").cast("string") == "1").select(F.col("ASN").cast("long").alias("asn")).distinct()


def read_serial_hijackers(spark: SparkSession, path: str) -> DataFrame:
    return parse_serial_hijackers(spark.read.option("header", True).csv(path))


def parse_cdn_lines(df: DataFrame) -> DataFrame:
    """Lines ``"asn","description"`` with the network's name in ``cdn``."""
    return df.select("cdn", F.regexp_extract("value", r'^"?([0-9]+)"?,', 1).try_cast("long").alias("asn")).where("asn is not null").distinct()


def read_cdn_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_cdn_lines(spark.read.text(path).withColumn("cdn", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)))


def parse_probes(df: DataFrame) -> DataFrame:
    """Tab-separated probe listings: id, AS, country, status, prefix, public, address, anchor; only connected probes."""
    f = F.transform(F.split("value", "\t"), lambda x: F.when(F.trim(x) != "None", F.nullif(F.trim(x), F.lit(""))))
    mark = lambda x: F.when(x == "✓", True).when(x == "✗", False)
    rows = df.where(F.size(f) >= 8).select(
        _nth(f, 0).try_cast("long").alias("probe_id"), digits(_nth(f, 1)).alias("asn"), _nth(f, 2).alias("country"), (_nth(f, 3) == "Connected").alias("connected"), px.parse(_nth(f, 4)).alias("prefix"), mark(_nth(f, 5)).alias("public"), _nth(f, 6).alias("address_v4"), mark(_nth(f, 7)).alias("anchor")
    )
    return rows.where("connected and probe_id is not null")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return parse_probes(lines(spark, path))


TRACE_JSON = "array<struct<result:array<struct<hop:int,result:array<struct<`from`:string>>>>>>"


def parse_traceroutes(df: DataFrame) -> DataFrame:
    """Traces as JSON, one document a row with ``trace_id``: one router path per packet, null where a packet had no answer."""
    traces = df.select("trace_id", F.posexplode(F.from_json("value", TRACE_JSON)).alias("nth", "t"))
    hops = traces.select("trace_id", "nth", F.explode("t.result").alias("h")).select("trace_id", "nth", "h.hop", F.posexplode("h.result").alias("packet", "r"))
    gathered = hops.groupBy("trace_id", "nth", "packet").agg(F.array_sort(F.collect_list(F.struct("hop", F.col("r.from").alias("router")))).alias("h"))
    return gathered.select("trace_id", "nth", "packet", F.transform("h", lambda x: x["router"]).alias("path"))


def read_traceroutes(spark: SparkSession, path: str) -> DataFrame:
    return parse_traceroutes(spark.read.text(path, wholetext=True).withColumn("trace_id", F.col("_metadata.file_path")))


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated stage files; an empty field is null."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "").option("emptyValue", "").csv(path)


def select_dumps(catalog: DataFrame, sources: list[str], types: list[str], start: int, end: int) -> DataFrame:
    """Dump files (``source, dump_type, time, url``) of the given projects and types inside a time interval."""
    return catalog.where(F.col("source").isin(sources) & F.col("dump_type").isin(types) & F.col("time").between(start, end))


def continent_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of country to continent as rows."""
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    return spark.read.text(path, wholetext=True).select(F.explode(pairs).alias("e")).select(F.col("e.key").alias("country"), F.col("e.value").alias("continent"))
