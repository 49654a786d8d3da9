"""Interval lookups and outliers against brute force."""

import datetime
import math
import random

import pytest

from moodspark.operators import aggregates, joins


def plain_lookup(values, ranges):
    out = []
    for v in values:
        held = [(p, x) for low, high, x, p in ranges if v is not None and low is not None and high is not None and not (isinstance(v, float) and math.isnan(v)) and low <= v <= high]
        out.append(min(held)[1] if held else None)
    return out


def looked_up(spark, kind, values, ranges):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").repartition(3)
    table = spark.createDataFrame(ranges, f"low {kind}, high {kind}, x string, p int").repartition(2)
    rows = joins.interval_lookup(df, "v", table, "low", "high", "x", "p", "found").collect()
    assert len(rows) == len(values)
    return [r.found for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_integers(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_RANGES", few)
    rng = random.Random(1)
    ranges = [(a := rng.randrange(-1000, 1000), a + rng.choice([-3, 0, 1, 7, 90, 1500]), f"r{i}", rng.randrange(50)) for i in range(200)]
    ranges += [(None, 5, "null", 0), (5, None, "null", 0), (-(10**15), -(10**14), "far", 1)]
    values = [rng.randrange(-1200, 1200) for _ in range(300)] + [None, 7, 7, 7, -5 * 10**14]
    assert looked_up(spark, "long", values, ranges) == plain_lookup(values, ranges)


def test_other_types(spark):
    rng = random.Random(2)
    ranges = [(a := rng.uniform(-5, 5), a + rng.choice([0.0, 1e-9, 0.25, 3.0]), f"r{i}", i % 9) for i in range(120)] + [(math.nan, 1.0, "nan", 0), (0.0, math.nan, "nan", 0)]
    values = [rng.uniform(-6, 6) for _ in range(200)] + [r[0] for r in ranges[:20]] + [r[1] for r in ranges[:20]] + [math.nan, None]
    assert looked_up(spark, "double", values, ranges) == plain_lookup(values, [r for r in ranges if r[2] != "nan"])
    day = datetime.date(2000, 1, 1)
    days = [day + datetime.timedelta(days=rng.randrange(-400, 400)) for _ in range(100)]
    ranges = [(d, d + datetime.timedelta(days=rng.choice([0, 3, 700])), f"r{i}", i % 5) for i, d in enumerate(days[:40])]
    assert looked_up(spark, "date", days, ranges) == plain_lookup(days, ranges)
    moment = datetime.datetime(1969, 12, 31, 23, 59, 59, 5)
    times = [moment + datetime.timedelta(microseconds=rng.randrange(10**9)) for _ in range(60)]
    ranges = [(t, t + datetime.timedelta(microseconds=rng.choice([0, 1, 10**6, 3 * 10**13])), f"r{i}", 5 - i % 5) for i, t in enumerate(times[:30])]
    assert looked_up(spark, "timestamp_ntz", times, ranges) == plain_lookup(times, ranges)
    assert looked_up(spark, "long", [1, 2], []) == [None, None]
    with pytest.raises(TypeError):
        looked_up(spark, "string", ["a"], [("a", "b", "x", 1)])


def quartile(values, p):
    at = p * (len(values) - 1)
    low = values[math.floor(at)]
    return low + (values[math.ceil(at)] - low) * (at - math.floor(at))


@pytest.mark.parametrize("ranks", [100, 10_000])
def test_outliers(spark, monkeypatch, ranks):
    monkeypatch.setattr(aggregates, "RANKS", ranks)
    rng = random.Random(ranks)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([round(rng.gauss(0, 1), 2), rng.gauss(0, 1) ** 3])) for i in range(9000)]
    rows += [(9000 + i, "ties", 4.0) for i in range(3000)] + [(20000, "ties", 5.0), (20001, "ties", None), (20002, "one", 1.0), (20003, "none", None), (20004, "two", -1.0), (20005, "two", 1.0), (20006, "a", math.nan)]
    df = spark.createDataFrame(rows, "i int, c string, v double").repartition(5)
    got = sorted((r.i, r.side, r.whisker_low, r.whisker_high) for r in aggregates.distribution_outliers(df, "c", "v").collect())
    expected, quarters = [], {}
    for c in {r[1] for r in rows}:
        values = sorted(v for _, k, v in rows if k == c and v is not None and not math.isnan(v))
        if not values:
            continue
        a, b = quartile(values, 0.25), quartile(values, 0.75)
        quarters[c] = (len(values), a, b)
        low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
        inner = [v for v in values if low <= v <= high]
        expected += [(i, "low" if v < low else "high", inner[0], inner[-1]) for i, k, v in rows if k == c and v is not None and not math.isnan(v) and not low <= v <= high]
    assert got == sorted(expected) and len(got) > 50
    found = {r.c: (r.n, r.q1, r.q3) for r in aggregates.exact_quartiles(df, "c", "v").collect()}
    assert found == quarters


def test_no_values(spark):
    assert aggregates.distribution_outliers(spark.createDataFrame([], "c string, v double"), "c", "v").collect() == []
