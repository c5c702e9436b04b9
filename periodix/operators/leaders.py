"""Running asset share per period and the market-leader flag.

An exact prefix scan, one strategy at every size:

1. One pass over the rows gives, per period, a sample of at most ``SAMPLE`` of
   its places in the ranking (amount desc, entity, then the other tie-break
   columns), dealt out by hash so that tasks merge theirs, and the range of its
   amounts' digits.
2. Every ``SAMPLE / SLICES``-th sampled place is a cut.  Cuts hold the tie-break
   columns too, so a slice between two cuts never holds a whole group of equal
   amounts, and a period is spread over as many tasks as it has slices.
3. The running sum is taken inside each slice by a JVM window; the slices above
   add an offset from one small aggregate.

Amounts are summed as integers: their decimal digits, counted in the finest
digit the period uses, down to ``DIGITS`` digits below its largest amount.  So a
share does not depend on how rows are dealt out, and any finite amount, from
4e-7 to 1e300, takes part.  A missing amount has no share and adds nothing; in a
period with an infinite amount, no row has a share.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodix.functions.columns import LEADER_THRESHOLD

SLICES = 32
SAMPLE = 512  # places per period
DIGITS = 27   # 10^11 amounts of this size fit a decimal(38)


def _tie_breaks(df: DataFrame, entity: str) -> list[str]:
    # Duplicated (entity, period) rows from two files still get a total order.
    return [entity, *(c for c in ("file", "no") if c in df.columns)]


def _decimal_digits(amount: Column) -> tuple[Column, Column, Column]:
    """``amount`` (a finite double) as ``digits * 10^exponent``, and the
    exponent its first digit stands at."""
    shown = F.abs(amount).cast("string")  # 12.5, 1.0E23, 4.0E-7
    mantissa = F.substring_index(shown, "E", 1)
    power = F.when(F.contains(shown, F.lit("E")), F.substring_index(shown, "E", -1).cast("int")).otherwise(0)
    part = F.substring_index(mantissa, ".", -1)
    part = F.when(part == "0", F.lit("")).otherwise(part)
    digits = F.concat(F.substring_index(mantissa, ".", 1), part).cast("long")
    exponent = power - F.length(part)
    return digits, exponent, exponent + F.length(digits.cast("string"))


def _in_units(digits: Column, exponent: Column, unit: Column) -> Column:
    """``digits * 10^(exponent - unit)``, cut to an integer."""
    powers = F.array(*[F.lit(Decimal(10) ** k).cast(f"decimal({DIGITS + 1},0)") for k in range(DIGITS + 1)])
    up, down = exponent - unit, unit - exponent
    raised = digits.cast("decimal(19,0)") * F.get(powers, up)
    cut = F.when(down < 19, F.floor(digits / F.get(powers, down))).otherwise(F.lit(0))
    units = F.when(digits == 0, F.lit(0)).when(up >= 0, raised).when(up < 0, cut)
    return units.cast(f"decimal({DIGITS + 1},0)")


def in_slices(df: DataFrame, period: str = "quarter", size: str = "assets",
              entity: str = "mfo_name") -> DataFrame:
    """The rows with their period again (``_p``), slice, place in the ranking,
    and amount in the period's units (missing: none)."""
    ties = _tie_breaks(df, entity)
    amount = F.col(size).cast("double")
    amount = F.when(~F.isnan(amount), amount)
    endless = F.abs(amount) == float("inf")
    finite = F.when(~endless, amount)
    digits, exponent, first = _decimal_digits(finite)
    used = F.when(digits != 0, exponent)
    place = F.struct(amount.isNull().alias("none"), (F.lit(0.0) - amount).alias("size"), *ties)
    keyed = df.withColumns({"_place": place, "_digits": digits, "_exponent": exponent})

    hashed = F.xxhash64("_place")
    sampled = (df.select(F.col(period).alias("_p"), place.alias("_place"), used.alias("_low"),
                         F.when(digits != 0, first).alias("_high"), endless.alias("_endless"))
               .groupBy("_p", F.pmod(hashed, F.lit(SAMPLE)).alias("_bucket")).agg(
                   F.min(F.struct(hashed.alias("h"), "_place")).alias("_pick"), F.min("_low").alias("_low"),
                   F.max("_high").alias("_high"), F.max("_endless").alias("_endless"), F.count("*").alias("_n")))
    every = max(1, SAMPLE // SLICES)
    periods = sampled.groupBy("_p").agg(  # SAMPLE places at most
        F.filter(F.array_sort(F.collect_list("_pick._place")), lambda _, i: i % every == every - 1).alias("_cuts"),
        F.greatest(F.min("_low"), F.max("_high") - DIGITS).alias("_unit"), F.max("_endless").alias("_endless"))

    same = F.col(period).eqNullSafe(F.col("_p"))
    units = _in_units(F.col("_digits"), F.col("_exponent"), F.col("_unit"))
    return (keyed.join(periods, same)
            .withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_place"))))
            .withColumn("_units", F.when(F.col(size) < 0, -units).otherwise(units)))


def running_share(df: DataFrame, period: str = "quarter", size: str = "assets",
                  entity: str = "mfo_name") -> DataFrame:
    """``cumulative_share`` = running sum of ``size`` (largest first) over
    the period total.  ROWS frame, so ties on ``size`` never share a value."""
    sliced = in_slices(df, period, size, entity)
    sums = sliced.groupBy(F.col("_p").alias("_q"), F.col("_slice").alias("_s")).agg(F.sum("_units").alias("_sum"))
    above = Window.partitionBy("_q").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_q", "_s", F.coalesce(F.sum("_sum").over(above), F.lit(0).cast("decimal(38,0)")).alias("_above"),
        F.sum("_sum").over(Window.partitionBy("_q")).alias("_total"))
    order = [F.asc("_place.none"), F.asc("_place.size"), *[F.asc(c) for c in _tie_breaks(df, entity)]]
    upto = Window.partitionBy("_p", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sliced.withColumn("_local", F.sum("_units").over(upto)).join(
        offsets, F.col("_p").eqNullSafe(F.col("_q")) & (F.col("_slice") == F.col("_s")))
    run, total = F.col("_above") + F.col("_local"), F.col("_total")
    amount_of = lambda units: F.concat(units.cast("string"), F.lit("E"), F.col("_unit").cast("string")).cast("double")
    # beyond the range of doubles with all their digits, units are divided
    whole = F.abs(amount_of(total))
    share = F.when((whole > 1e-290) & (whole < float("inf")), F.try_divide(amount_of(run), amount_of(total))).otherwise(
        F.try_divide(run.cast("double"), total.cast("double")))
    has = F.col("_units").isNotNull() & ~F.coalesce("_endless", F.lit(False))
    return joined.withColumn("cumulative_share", F.when(has, share)).select(*df.columns, "cumulative_share")


def mark_leaders(df: DataFrame, threshold: float = LEADER_THRESHOLD, period: str = "quarter",
                 size: str = "assets", entity: str = "mfo_name") -> DataFrame:
    """W1 + W2: ``is_leader`` = running share <= threshold (inclusive).

    The firm that crosses the threshold is not a leader; a single firm above
    it leaves the period without leaders; a missing share is not a leader.
    """
    out = running_share(df, period, size, entity)
    return out.withColumn(
        "is_leader", F.coalesce(F.col("cumulative_share") <= F.lit(threshold), F.lit(False))
    )
