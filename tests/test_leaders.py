"""The leader scan against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from periodix.operators import leaders as L


def brute(rows):
    out = {}
    for period in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == period]
        known = [r for r in mine if r[2] is not None and not math.isnan(r[2])]
        endless = any(math.isinf(r[2]) for r in known)
        known.sort(key=lambda r: (-r[2], r[1]))
        exact = [Fraction(repr(r[2])) if not math.isinf(r[2]) else 0 for r in known]
        total, run = sum(exact), 0
        for r, x in zip(known, exact):
            run += x
            out[r[:2]] = None if endless or not total else float(run / total)
        out.update({r[:2]: None for r in mine if r not in known})
    return out


def shares(spark, rows):
    df = spark.createDataFrame(rows, "quarter STRING, mfo_name STRING, assets DOUBLE").repartition(3)
    got = L.mark_leaders(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["is_leader"] == (r["cumulative_share"] is not None and r["cumulative_share"] <= 0.8)
    return {(r["quarter"], r["mfo_name"]): r["cumulative_share"] for r in got}


def agree(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-15)), k


def test_any_finite_double(spark):
    rnd = random.Random(1)
    rows = [("wide", f"f{k:03}", rnd.choice([1, -1, 3]) * 10.0 ** rnd.uniform(-9, 9)) for k in range(300)]
    rows += [("huge", f"f{k}", x) for k, x in enumerate([1e300, 2e300, 1.5e299, 7.0, 1e23])]
    rows += [("small", "a", 4e-7), ("small", "b", 3e-7), ("tiny", "a", 5e-324), ("tiny", "b", 1e-310)]
    rows += [("mixed", "a", 1e23), ("mixed", "b", 4e-7), ("odd", "a", None), ("odd", "b", math.nan), ("odd", "c", 2.0)]
    rows += [("zero", "a", 0.0), ("zero", "b", -0.0), (None, "a", 3.0), (None, "b", 1.0)]
    got = shares(spark, rows)
    agree(got, brute(rows))
    assert got["small", "a"] == pytest.approx(4 / 7) and got["huge", "f1"] < 0.7


def test_infinite_amounts_leave_the_period_without_shares(spark):
    rows = [("q", "a", math.inf), ("q", "b", 5.0), ("r", "a", 5.0), ("r", "b", -math.inf), ("s", "a", 1.0)]
    assert shares(spark, rows) == {("q", "a"): None, ("q", "b"): None, ("r", "a"): None, ("r", "b"): None, ("s", "a"): 1.0}


def test_threshold_is_exact_on_cents(spark):
    rows = [("q", "a", 0.1), ("q", "b", 0.7), ("q", "c", 0.2), ("r", "a", 0.3), ("r", "b", 0.3), ("r", "c", 0.2), ("r", "d", 0.2)]
    got = shares(spark, rows)
    assert got["q", "b"] == 0.7 and got["r", "c"] == 0.8


def test_tied_amounts_are_split(spark):
    """Ten thousand equal amounts: no slice holds more than a few of the cuts' share."""
    rows = [("q", f"f{k:05}", 7.5) for k in range(10_000)] + [("q", "top", 9.0), ("r", "one", 1.0)]
    got = shares(spark, rows)
    agree(got, brute(rows))
    df = spark.createDataFrame(rows, "quarter STRING, mfo_name STRING, assets DOUBLE")
    slices = [r["count"] for r in L.in_slices(df).groupBy("_slice").count().collect()]
    assert len(slices) > L.SLICES // 2 and max(slices) < 3 * len(rows) / L.SLICES


def test_repeated_rows_get_each_place_once(spark):
    df = spark.createDataFrame([("q", "a", 5.0)] * 4, "quarter STRING, mfo_name STRING, assets DOUBLE")
    got = sorted(r["cumulative_share"] for r in L.running_share(df).collect())
    assert got == [0.25, 0.5, 0.75, 1.0]


def test_sizes_of_other_types(spark):
    df = spark.createDataFrame([("q", "a", 5), ("q", "b", 15)], "quarter STRING, mfo_name STRING, assets INT")
    assert {r["mfo_name"]: r["cumulative_share"] for r in L.running_share(df.withColumn("assets", F.col("assets").cast("decimal(12,2)"))).collect()} \
        == {"b": 0.75, "a": 1.0}
