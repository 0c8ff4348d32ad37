"""IP prefixes as a struct column: family (4 or 6), network bits as two longs, length.

IPv4 networks use ``lo`` alone. Host bits are zero. Containment joins are equi-joins on ancestors: a prefix of length n has
at most n + 1 ancestors, of which only those of lengths that occur on the other side are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<family:tinyint,hi:bigint,lo:bigint,len:int>"


def make(family: Column | int, hi: Column | int, lo: Column | int, length: Column | int) -> Column:
    """A prefix struct; host bits are cleared."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    family, hi, lo, length = (col(x) for x in (family, hi, lo, length))
    masked_hi, masked_lo = masked(family, hi, lo, length)
    return F.struct(family.cast("tinyint").alias("family"), masked_hi.alias("hi"), masked_lo.alias("lo"), length.cast("int").alias("len"))


def _mask(bits: Column) -> Column:
    """A long with its upper ``bits`` bits set; a shift by 64 would do nothing, so 0 is apart."""
    return F.when(bits <= 0, F.lit(0)).when(bits >= 64, F.lit(-1)).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int"))).cast("long")


def masked(family: Column, hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """Network bits with everything beyond ``length`` cleared."""
    # 32 bits of IPv4 stand at the low end.
    low_bits = F.when(family == 4, length + 32).otherwise(length - 64)
    keep_hi = F.when(family == 4, F.lit(0).cast("long")).otherwise(hi.bitwiseAND(_mask(length)))
    return keep_hi.cast("long"), lo.cast("long").bitwiseAND(_mask(low_bits))


def truncate(prefix: Column, length: Column) -> Column:
    """The ancestor of ``length`` bits."""
    return make(prefix["family"], prefix["hi"], prefix["lo"], length)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is found once a row, however often ``use`` names it: an array of one element names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _v4(text: Column) -> Column:
    def joined(octets: Column) -> Column:
        o = [F.get(octets, F.lit(i)) for i in range(4)]
        valid = (F.size(octets) == 4) & o[0].between(0, 255) & o[1].between(0, 255) & o[2].between(0, 255) & o[3].between(0, 255)
        return F.when(valid, ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])

    return _once(F.transform(F.split(text, r"\."), lambda o: o.try_cast("long")), joined)


def _v6(text: Column) -> Column:
    """Both halves of an IPv6 address as a struct; ``::`` stands for as many zero groups as are missing."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def whole(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        return F.when(F.size(sides) <= 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right))

    def halves(groups: Column) -> Column:
        ok = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        half = lambda start: F.aggregate(
            F.slice(groups, start, 4), F.lit(0).cast("long"), lambda a, g: F.call_function("shiftleft", a, F.lit(16)).bitwiseOR(F.conv(g, 16, 10).cast("long"))
        )
        return F.when(ok, F.struct(half(1).alias("hi"), half(5).alias("lo")))

    return _once(_once(F.split(text, "::", -1), whole), halves)


def parse(text: Column) -> Column:
    """Prefix of a text such as ``1.2.0.0/16`` or ``2001:db8::/32``; without a length a host route. Null if malformed."""

    def parts(text: Column, address: Column) -> Column:
        is_v6 = F.contains(address, F.lit(":"))
        v4 = F.struct(F.lit(0).cast("long").alias("hi"), _v4(address).alias("lo"))
        length = F.when(F.contains(text, F.lit("/")), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int")).when(is_v6, 128).otherwise(32)
        return F.struct(F.when(is_v6, 6).otherwise(4).alias("family"), F.when(is_v6, _v6(address)).otherwise(v4).alias("bits"), length.alias("len"))

    def made(p: Column) -> Column:
        bits, width = p["bits"], F.when(p["family"] == 6, 128).otherwise(32)
        fits = bits["hi"].isNotNull() & bits["lo"].isNotNull() & p["len"].between(0, width)
        return F.when(fits, make(p["family"], bits["hi"], bits["lo"], p["len"]))

    return _once(_once(F.trim(text), lambda t: _once(F.split_part(t, F.lit("/"), F.lit(1)), lambda address: parts(t, address))), made)


def to_text(prefix: Column) -> Column:
    """Text of a prefix; IPv6 with all eight groups written out, without leading zeros."""
    part = lambda x, shift: F.call_function("shiftrightunsigned", x, F.lit(shift))
    octets = [part(prefix["lo"], s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)]
    groups = [F.lower(F.hex(part(prefix[h], s).bitwiseAND(F.lit(65535).cast("long")))) for h in ("hi", "lo") for s in (48, 32, 16, 0)]
    return F.concat(F.when(prefix["family"] == 4, F.concat_ws(".", *octets)).otherwise(F.concat_ws(":", *groups)), F.lit("/"), prefix["len"].cast("string"))


def order_key(prefix: Column) -> Column:
    """Sorts as family, network address (unsigned), length."""
    flip = F.lit(-(2**63)).cast("long")
    return F.struct(prefix["family"], prefix["hi"].bitwiseXOR(flip), prefix["lo"].bitwiseXOR(flip), prefix["len"])


def masklen(prefix: Column) -> Column:
    return prefix["len"]


def covers(a: Column, b: Column) -> Column:
    """``a`` contains or equals ``b``."""
    return (a["family"] == b["family"]) & (a["len"] <= b["len"]) & (truncate(b, a["len"]) == a)


def covered_by(a: Column, b: Column) -> Column:
    return covers(b, a)


def strictly_covered_by(a: Column, b: Column) -> Column:
    return covers(b, a) & (a["len"] > b["len"])


def lengths(df: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Prefix lengths that occur, as one row with an array for each family: at most 33 and 129 numbers."""
    p = F.col(prefix)
    return df.agg(*[F.collect_set(F.when(p["family"] == f, p["len"])).alias(f"_lengths_{f}") for f in (4, 6)])


def with_ancestors(df: DataFrame, of: DataFrame, prefix: str = "prefix", strict: bool = False, name: str = "ancestor", outer: bool = False) -> DataFrame:
    """A row per ancestor of the lengths in ``of``, the prefix itself included unless ``strict``. Rows without one drop out, or with ``outer`` have a null.

    ``of`` is the one row that ``lengths`` makes; it is found by the job that needs it, not while the plan is built.
    """
    p = F.col(prefix)
    choice = F.when(p["family"] == 4, F.col("_lengths_4")).otherwise(F.col("_lengths_6"))
    fits = (lambda n: n < p["len"]) if strict else (lambda n: n <= p["len"])
    explode = F.explode_outer if outer else F.explode
    wide = df.crossJoin(F.broadcast(of)).withColumn("_len", explode(F.filter(choice, fits)))  # one row
    ancestor = truncate(p, F.col("_len"))
    return wide.withColumn(name, F.when(F.col("_len").isNotNull(), ancestor) if outer else ancestor).drop("_len", "_lengths_4", "_lengths_6")


def containment_join(df: DataFrame, covering: DataFrame, prefix: str = "prefix", covering_prefix: str = "prefix", strict: bool = False, how: str = "inner") -> DataFrame:
    """Rows of ``df`` with the rows of ``covering`` whose prefix contains theirs, by an equi-join on ancestors.

    ``how``: inner, left_semi. Column names must differ but for the prefix, which is renamed ``covering_prefix_`` on the right.
    Null prefixes match nothing. The semi-join expands distinct prefixes only, and keeps equal rows of ``df`` apart.
    """
    right = covering.where(F.col(covering_prefix).isNotNull()).withColumnRenamed(covering_prefix, "covering_prefix_")
    of = lengths(right, "covering_prefix_")
    if how == "left_semi":
        distinct = df.select(F.col(prefix).alias("_prefix")).where("_prefix is not null").distinct()
        covered = with_ancestors(distinct, of, "_prefix", strict).join(right, F.col("ancestor") == F.col("covering_prefix_"), "left_semi")
        return df.join(covered.select("_prefix"), F.col(prefix) == F.col("_prefix"), "left_semi")
    left = with_ancestors(df.where(F.col(prefix).isNotNull()), of, prefix, strict)
    return left.join(right, F.col("ancestor") == F.col("covering_prefix_"), how).drop("ancestor")
