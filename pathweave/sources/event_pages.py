"""Incident reports from their pages: a list page with a row an event, and a page of details for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.scalars import digits, parse_as_info
from pathweave.sources.markup import all_cells, table_rows

#: Types of events as the list names them.
HIJACK, LEAK, OUTAGE = "Possible Hijack", "BGP Leak", "Outage"
#: Rows at the end of a list page that are no events.
DROP_LAST = 10


def listed_events(pages: DataFrame, key: list[str], html: str = "html", drop_last: int = DROP_LAST) -> DataFrame:
    """Events of list pages: ``key``, type, country, AS texts, start, end (null while open), url and number.

    The last ``drop_last`` rows of a page are left out, as are rows without six cells, a start or a numbered url.
    """
    rows = table_rows(pages, key, html).where((F.col("nth") < F.col("n_rows") - drop_last) & (F.size("cells") >= 6))
    cell = lambda n: F.get("cells", F.lit(n))
    text = lambda n: F.nullif(F.array_join(cell(n)["strings"], " "), F.lit(""))
    time = lambda n: F.try_to_timestamp(F.concat(text(n), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    url = F.get(cell(5)["links"], F.lit(0))
    events = rows.select(
        *key, text(0).alias("event_type"), text(1).alias("country"), cell(2)["strings"].alias("as_info"),
        time(3).alias("start_time"), time(4).alias("end_time"), url.alias("url"), F.regexp_extract(url, "([0-9]+)/?$", 1).try_cast("long").alias("event_number"),
    )
    return events.where("start_time is not null and event_number is not null")


def with_details(events: DataFrame, pages: DataFrame, html: str = "html") -> DataFrame:
    """Events with the cells of their own pages (``url, html``) as ``details``; events without a page, or one without cells, drop out."""
    return events.join(all_cells(pages.select("url", html), ["url"], html), "url")


def _at(n: int) -> Column:
    """Text of a detail cell, counted from the end, since an event that is over has cells more at the start."""
    return F.array_join(F.try_element_at("details", F.lit(-n)), " ")


def _after_colon(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, "(?s)^.+?:(.+)$", 1))


def _path(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_extract(text, r"([0-9][0-9\s]*)", 1), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))


def _who(n: int) -> Column:
    return parse_as_info(F.get("as_info", F.lit(n)))


def hijacks(events: DataFrame) -> DataFrame:
    """Hijacks of ``with_details``: expected and detected origin, their prefixes, the path on which it was seen and by how many peers."""
    return events.where(F.trim("event_type") == HIJACK).select(
        "event_number", "country", "start_time", "end_time", "url",
        _who(1)["name"].alias("expected_origin_name"), _who(1)["number"].alias("expected_origin_number"), _who(3)["name"].alias("detected_origin_name"), _who(3)["number"].alias("detected_origin_number"),
        px.parse(_after_colon(_at(6))).alias("expected_prefix"), px.parse(_after_colon(_at(4))).alias("more_specific_prefix"), _path(_at(2)).alias("detected_as_path"), digits(_at(1)).cast("int").alias("detected_by_bgpmon_peers"),
    ).where("expected_prefix is not null")


def leaks(events: DataFrame) -> DataFrame:
    """Leaks of ``with_details``: origin and leaker, the prefix, to whom it leaked, an example of a path and by how many peers it was seen."""
    to = F.transform(F.filter(F.try_element_at("details", F.lit(-3)), lambda _, i: i > 0), parse_as_info)
    return events.where(F.trim("event_type") == LEAK).select(
        "event_number", "country", "start_time", "end_time", "url",
        _who(1)["name"].alias("origin_as_name"), _who(1)["number"].alias("origin_as_number"), _who(3)["name"].alias("leaker_as_name"), _who(3)["number"].alias("leaker_as_number"),
        px.parse(F.regexp_extract(_after_colon(_at(5)), r"([0-9A-Fa-f.:]+/[0-9]+)", 1)).alias("leaked_prefix"), F.transform(to, lambda x: x["name"]).alias("leaked_to_name"), F.transform(to, lambda x: x["number"]).alias("leaked_to_number"),
        _path(_at(2)).alias("example_as_path"), digits(_at(1)).cast("int").alias("detected_by_bgpmon_peers"),
    ).where("leaked_prefix is not null")


def outages(events: DataFrame) -> DataFrame:
    """Outages of ``with_details``: the AS, which may be unknown, and the number and percentage of its prefixes that are affected."""
    numbers = F.regexp_extract_all(_at(1), F.lit("([0-9]+)"), F.lit(1))
    return events.where(F.trim("event_type") == OUTAGE).select(
        "event_number", "country", "start_time", "end_time", "url", _who(0)["name"].alias("as_name"), _who(0)["number"].alias("as_number"),
        F.get(numbers, F.lit(0)).cast("int").alias("number_prefixes_affected"), F.get(numbers, F.lit(1)).cast("short").alias("percent_prefixes_affected"),
    ).where("number_prefixes_affected is not null")
