"""Rows and cells of HTML pages by their nesting: tokens of a page, and window functions that know which tags are open at each.

A page is cut into tags and texts. Of the tags that are asked for, a running sum tells how many are open at every token, so the
innermost open one is that of this depth which was opened last, and the tag that closes it is the next one of its depth. This
is what a stack of open tags would say, with one sort a page and no array that grows. A page is handled in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scripts, styles and comments are one token each; their contents are no tags.
TOKEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[^<]+"
#: The entities that are turned into characters, in this order.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _tokens(pages: DataFrame, key: list[str], html: str, names: list[str]) -> DataFrame:
    """A row a token: position, tag name, whether it opens or closes one of ``names``, depth, text and link."""
    raw = pages.select(*key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)[\s/>]", 1))
    is_tag = F.col("token").startswith("<")
    tracked = name.isin(names) & ~F.col("token").endswith("/>")
    step = F.when(tracked & F.col("token").startswith("</"), -1).when(tracked, 1).otherwise(0)
    text = F.when(~is_tag, F.nullif(F.trim(F.regexp_replace(unescaped(F.col("token")), r"[\s ]+", " ")), F.lit("")))
    link = F.when(name == "a", unescaped(F.nullif(F.regexp_extract("token", r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1), F.lit(""))))
    order = Window.partitionBy(*key).orderBy("pos")
    return raw.select(*key, "pos", name.alias("name"), step.alias("step"), text.alias("text"), link.alias("link"), "token").withColumn("depth", F.sum("step").over(order))


def _elements(pages: DataFrame, key: list[str], names: list[str], html: str) -> DataFrame:
    """Every opened element: ``key, pos, name, closed, parent, held`` (texts and links with their places).

    A token plays its parts at a depth: a tag that opens does so at its own depth and asks for its parent one above; a
    text or link belongs to what is open. What was opened last at that depth answers, and all about an element meets once.
    """
    tokens = _tokens(pages, key, html, names)
    part = lambda role, depth: F.struct(F.lit(role).alias("role"), depth.alias("level"))
    depth, step = F.col("depth"), F.col("step")
    parts = F.when(step == 1, F.array(part(1, depth), part(2, depth - 1))).when(step == -1, F.array(part(-1, depth + 1))).when(F.col("text").isNotNull() | F.col("link").isNotNull(), F.array(part(0, depth)))
    rows = tokens.select(*key, "pos", "name", "text", "link", F.explode(parts).alias("p")).select(*key, "pos", "name", "text", "link", "p.*")
    role = F.col("role")
    before = Window.partitionBy(*key, "level").orderBy("pos", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*key, "level").orderBy(F.col("pos").desc(), F.col("role").desc()).rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(role == 1, F.col("pos")), ignorenulls=True).over(before)
    closing = F.last(F.when(F.abs(role) == 1, F.struct("role", "name")), ignorenulls=True).over(after)
    placed = rows.withColumn("owner", owner).withColumn("closing", closing)
    element = F.when(role > 0, F.col("pos")).when(role == 0, F.col("owner"))
    closed = F.coalesce((F.col("closing.role") == -1) & (F.col("closing.name") == F.col("name")), F.lit(False))
    return placed.withColumn("element", element).where("element is not null").groupBy(*key, F.col("element").alias("pos")).agg(
        F.max(F.when(role == 1, F.col("name"))).alias("name"), F.max(F.when(role == 1, closed)).alias("closed"), F.max(F.when(role == 2, F.col("owner"))).alias("parent"),
        F.array_sort(F.collect_list(F.when(role == 0, F.struct("pos", "text", "link")))).alias("held"),
    )


def _said(what: str) -> Column:
    return F.transform(F.filter("held", lambda x: x[what].isNotNull()), lambda x: x[what])


def elements(pages: DataFrame, key: list[str], names: list[str], html: str = "html") -> DataFrame:
    """Every closed element of the given tag names: ``key, name, pos, parent, strings, links``.

    ``pos`` is the place of its opening tag, ``parent`` that of the innermost element of these names around it, or null. ``strings``
    are the texts directly in it or in tags of other names inside it, trimmed, without empty ones, in order; ``links`` the targets of
    anchors there. An element whose tag isn't closed before the one around it is, is left out, and so is one without any close.
    Null pages have no elements. ``key`` must tell pages apart.
    """
    return _elements(pages, key, names, html).where("closed").select(*key, "name", "pos", "parent", _said("text").alias("strings"), _said("link").alias("links"))


def table_rows(pages: DataFrame, key: list[str], html: str = "html", row: str = "tr", cell: str = "td") -> DataFrame:
    """Rows of pages with the cells that stand directly in them: ``key, nth, n_rows, cells``.

    ``nth`` counts the row tags of a page from 0, those without cells included, and ``n_rows`` all of them, closed or not; a cell has
    its ``strings`` and ``links``.
    """
    is_row = F.col("name") == row
    made = F.when(~is_row & F.col("closed"), F.struct("pos", _said("text").alias("strings"), _said("link").alias("links")))
    of_row = _elements(pages, key, [row, cell], html).withColumn("row", F.when(is_row, F.col("pos")).otherwise(F.col("parent")))
    rows = of_row.groupBy(*key, "row").agg(F.max(is_row).alias("is_row"), F.max(F.when(is_row, F.col("closed"))).alias("closed"), F.array_sort(F.collect_list(made)).alias("cells")).where("is_row")
    page = Window.partitionBy(*key)
    numbered = rows.withColumn("nth", F.row_number().over(page.orderBy("row")) - 1).withColumn("n_rows", F.count(F.lit(1)).over(page))
    return numbered.where("closed").select(*key, "nth", "n_rows", F.transform("cells", lambda c: F.struct(c["strings"], c["links"])).alias("cells"))


def all_cells(pages: DataFrame, key: list[str], html: str = "html", cell: str = "td") -> DataFrame:
    """The cells of each page in order, as an array of arrays of strings; a page without any has no row."""
    found = elements(pages, key, [cell], html)
    return found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "strings"))), lambda c: c["strings"]).alias("details"))
