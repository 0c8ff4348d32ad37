"""Scalar expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Validity codes, worse ascending.
VALID, UNKNOWN, INVALID_BY_LENGTH, INVALID_BY_ORIGIN, INVALID_BY_ALL = 0, 1, 2, 3, 4
VALIDITY_NAMES = {0: "VALID", 1: "UNKNOWN", 2: "INVALID_BY_LENGTH", 3: "INVALID_BY_ORIGIN", 4: "INVALID_BY_ALL"}
#: Codes that a policy blocks.
BLOCKED = {"asn": (3, 4), "length": (2,), "rov": (2, 3, 4)}
#: Reserved numbers in which a trace ends.
TERMINALS = {64512: "blackholed", 64513: "hijacked", 64514: "not_hijacked"}


def validity_name(code: Column) -> Column:
    pairs = [x for k, v in VALIDITY_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), code.cast("int"))


def validity_code(name: Column) -> Column:
    pairs = [x for k, v in VALIDITY_NAMES.items() for x in (F.lit(v), F.lit(k))]
    return F.element_at(F.create_map(*pairs), F.upper(name)).cast("short")


def trunc2(x: Column) -> Column:
    """Two decimals, cut toward zero."""
    return F.when(x >= 0, F.floor(x * 100)).otherwise(F.ceil(x * 100)) / 100


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """Division that gives null for a zero whole."""
    return part * scale / F.nullif(whole, F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)", 1).try_cast("long")


#: Different values that two arrays may have for their edit distance to run on texts: code points below the surrogates.
TEXT_VALUES = 0xD7FF


def array_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two whole arrays; null if either is null. Null elements are equal to each other.

    The values of both arrays are numbered, and each array becomes a text with one character a value, so that the built-in
    function runs. Arrays with more than ``TEXT_VALUES`` different values go through ``folded_edit_distance``.
    """
    code = lambda place: F.lpad(F.hex(F.coalesce(place, F.lit(0))), 4, "0")

    def as_text(x: Column, values: Column) -> Column:
        return F.decode(F.unhex(F.array_join(F.transform(x, lambda v: code(F.array_position(values, v))), "")), "UTF-16BE")

    # An array of one element names the values, so they are found once a row.
    on_texts = F.get(F.transform(F.array(F.array_union(a, b)), lambda values: F.levenshtein(as_text(a, values), as_text(b, values))), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(F.array_union(a, b)) <= TEXT_VALUES, on_texts).otherwise(folded_edit_distance(a, b)))


def folded_edit_distance(a: Column, b: Column) -> Column:
    """The same by a fold over ``a`` that keeps one row of the table, which has one entry per element of ``b`` and one more."""
    first = F.sequence(F.lit(0), F.size(b))

    def next_row(row: Column, x: Column) -> Column:
        start = F.array(F.element_at(row, 1) + 1)
        cells = F.arrays_zip(F.slice(row, 1, F.size(b)).alias("diagonal"), F.slice(row, 2, F.size(b)).alias("above"), b.alias("y"))

        def cell(out: Column, c: Column) -> Column:
            change = c["diagonal"] + F.when(c["y"].eqNullSafe(x), 0).otherwise(1)
            return F.concat(out, F.array(F.least(change, c["above"] + 1, F.element_at(out, -1) + 1)))

        return F.aggregate(cells, start, cell)

    distance = F.element_at(F.aggregate(a, first, next_row), -1)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(b) == 0, F.size(a)).otherwise(distance))


def parse_as_info(text: Column) -> Column:
    """Name and number of texts such as ``NAME (AS 123)`` or ``123 ... (NAME)``, or bare digits; nulls otherwise."""
    named = F.regexp_extract(text, r"^\s*(.+?)\s*\(AS\s*([0-9]+)\)", 1)
    number = F.regexp_extract(text, r"^\s*(.+?)\s*\(AS\s*([0-9]+)\)", 2)
    second = F.regexp_extract(text, r"^\s*([0-9]+)\b.*?\((.+?)\)\s*$", 1)
    second_name = F.regexp_extract(text, r"^\s*([0-9]+)\b.*?\((.+?)\)\s*$", 2)
    name = F.when(number != "", named).when(second != "", second_name)
    value = F.coalesce(F.nullif(number, F.lit("")), F.nullif(second, F.lit("")), F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit("")))
    return F.struct(name.alias("name"), value.try_cast("long").alias("number"))
