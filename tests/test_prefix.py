"""Prefix parsing, order and containment, IPv6 and edges included."""

import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathweave.functions import nesting, scalars
from pathweave.functions import prefix as px
from pathweave.functions.scalars import array_edit_distance, folded_edit_distance, parse_as_info, trunc2


def test_parse_and_text(spark):
    rows = [("1.2.3.0/24",), ("0.0.0.0/0",), ("255.255.255.255/32",), ("2001:db8::/32",), ("::/0",), ("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128",), ("1.2.3.4",), ("1.2.3",), ("1.2.3.4/33",), ("::1::/64",), ("300.1.1.1/8",), ("",), (None,)]
    out = spark.createDataFrame(rows, "t string").select("t", px.parse(F.col("t")).alias("p"), px.to_text(px.parse(F.col("t"))).alias("x")).collect()
    for r in out:
        try:
            want = ipaddress.ip_network(r.t) if r.t else None
        except ValueError:
            want = None
        if want is None:
            assert r.p is None, r.t
        else:
            got = (r.p.hi % 2**64) << 64 | (r.p.lo % 2**64)
            assert (r.p.family, got, r.p.len) == (want.version, int(want.network_address), want.prefixlen)
            assert ipaddress.ip_network(r.x) == want


networks = st.one_of(
    st.builds(lambda a, n: ipaddress.ip_network((a, n), strict=False), st.integers(0, 2**32 - 1), st.integers(0, 32)),
    st.builds(lambda a, n: ipaddress.ip_network((ipaddress.IPv6Address(a), n), strict=False), st.integers(0, 2**128 - 1), st.integers(0, 128)),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(networks, min_size=1, max_size=25))
def test_containment_join_agrees_with_brute_force(spark, nets):
    nets = sorted({str(n) for n in nets} | {"10.0.0.0/8", "10.1.0.0/16", "::/0", "0.0.0.0/0", "::a00:0/104"})
    df = spark.createDataFrame([(n,) for n in nets] + [(None,)], "t string").select("t", px.parse(F.col("t")).alias("prefix"))
    for strict in (False, True):
        got = {(r.t, r.u) for r in px.containment_join(df, df.withColumnRenamed("t", "u"), strict=strict).select("t", "u").collect()}
        parsed = {n: ipaddress.ip_network(n) for n in nets}
        want = {(a, b) for a in nets for b in nets if parsed[a].version == parsed[b].version and parsed[a].subnet_of(parsed[b]) and not (strict and a == b)}
        assert got == want
    order = [r.t for r in df.where("prefix is not null").orderBy(px.order_key(F.col("prefix"))).collect()]
    assert order == sorted(nets, key=lambda n: (parsed[n].version, int(parsed[n].network_address), parsed[n].prefixlen))


def _network(p):
    return p and ipaddress.ip_network((ipaddress.IPv6Address((p.hi % 2**64) << 64 | p.lo % 2**64) if p.family == 6 else p.lo, p.len))


def _near(rng):
    """Networks of both families, crowded at the ends of the address spaces and of ranges."""
    if rng.random() < 0.5:
        return ipaddress.ip_network(((rng.choice([0, 10 << 24, 2**32 - 256, 2**31]) + rng.randrange(1 << rng.choice([1, 8, 20]))) % 2**32, rng.choice([0, 1, 8, 9, 16, 20, 24, 31, 32])), strict=False)
    value = (rng.choice([0, 1 << 127, 0xFFFF << 112, 2**128 - 1 - (1 << 40)]) + rng.randrange(1 << rng.choice([1, 30, 70]))) % 2**128
    return ipaddress.ip_network((ipaddress.IPv6Address(value), rng.choice([0, 1, 16, 63, 64, 65, 100, 127, 128])), strict=False)


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 30), (3, 300)])
def test_nesting_agrees_with_brute_force(spark, seed, n):
    rng = random.Random(seed)
    nets, asked = sorted({_near(rng) for _ in range(n)}, key=str), sorted({_near(rng) for _ in range(150)}, key=str)
    frame = lambda some: spark.createDataFrame([(str(x),) for x in some] * 2 + [(None,)], "t string").select("t", px.parse(F.col("t")).alias("prefix")).repartition(3)
    within = lambda a, b: a.version == b.version and a.subnet_of(b)
    known = frame(nets)
    tops = {_network(r.prefix): _network(r.top) for r in nesting.outermost(known).collect()}
    assert tops == {x: min((y for y in nets if within(x, y)), key=lambda y: y.prefixlen) for x in nets}
    covers = nesting.innermost(frame(asked), known).collect()
    assert len(covers) == len(asked)
    assert {_network(r.prefix): _network(r.cover) for r in covers} == {x: max((y for y in nets if within(x, y)), key=lambda y: y.prefixlen, default=None) for x in asked}
    keyed = known.withColumn("asn", F.pmod(F.hash("t"), F.lit(3)))
    key = {ipaddress.ip_network(r.t): r.asn for r in keyed.collect() if r.t}
    assert {(r.asn, _network(r.prefix)) for r in nesting.overruled(keyed, "asn").collect()} == {(key[x], x) for x in nets if any(y != x and key[y] == key[x] and within(y, x) for y in nets)}


def test_nesting_of_nothing(spark):
    none = spark.createDataFrame([], f"prefix {px.TYPE}, asn long")
    some = spark.createDataFrame([("10.0.0.0/8",)], "t string").select(px.parse(F.col("t")).alias("prefix"))
    assert nesting.outermost(none).count() == nesting.overruled(none, "asn").count() == nesting.innermost(none, some).count() == 0
    assert [r.cover for r in nesting.innermost(some, none).collect()] == [None]


def test_containment_predicates(spark):
    a, b = px.parse(F.lit("10.0.0.0/8")), px.parse(F.lit("10.2.0.0/16"))
    r = spark.range(1).select(px.covers(a, b), px.covered_by(a, b), px.strictly_covered_by(b, a), px.strictly_covered_by(a, a), px.covers(a, px.parse(F.lit("::a00:0/104")))).first()
    assert list(r) == [True, False, True, False, False]


def test_edit_distance(spark):
    rng = random.Random(9)
    pairs = [([1, 2, 3], [1, 3]), ([5, 6], [7, 6, 5]), ([], []), ([], [1]), ([1], []), (None, [1]), ([1], None), ([None, 1, None], [None, None, 2]), ([1, None], [1, 0]), (list(range(2**40, 2**40 + 300)), list(range(2**40 + 5, 2**40 + 305)))]
    pairs += [([rng.randrange(6) for _ in range(rng.randint(0, 12))], [rng.randrange(6) for _ in range(rng.randint(0, 12))]) for _ in range(60)]

    def brute(a, b):
        if a is None or b is None:
            return None
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1, *row[1:]] if not b else (lambda old: [*_next(old, x, b, i)])(row)
        return row[-1]

    def _next(old, x, b, i):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(old[j] + (x != y), old[j + 1] + 1, new[-1] + 1))
        return new

    rows = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").select("a", "b", array_edit_distance(F.col("a"), F.col("b")).alias("d"), folded_edit_distance(F.col("a"), F.col("b")).alias("f")).collect()
    assert [(r.d, r.f) for r in rows] == [(brute(r.a, r.b), brute(r.a, r.b)) for r in rows]


def test_edit_distance_beyond_the_range_of_texts(spark, monkeypatch):
    monkeypatch.setattr(scalars, "TEXT_VALUES", 3)
    rows = spark.createDataFrame([([1, 2, 3], [1, 3]), ([1, 2, 3, 4], [1, 5])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in rows.select(array_edit_distance(F.col("a"), F.col("b"))).collect()] == [1, 3]


def test_scalars(spark):
    r = spark.range(1).select(trunc2(F.lit(-1.239)), trunc2(F.lit(1.239)), parse_as_info(F.lit("NAME (AS 12)")), parse_as_info(F.lit("12 x (NAME)")), parse_as_info(F.lit("N/A"))).first()
    assert (r[0], r[1]) == (-1.23, 1.23)
    assert tuple(r[2]) == ("NAME", 12) and tuple(r[3]) == ("NAME", 12) and tuple(r[4]) == (None, None)
