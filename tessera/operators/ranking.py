"""Global order without a single task: ranks and running values by ranges of the order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def ranges(df: DataFrame, order: str, n: int = RANGES) -> Column:
    """The range (0 to n) a row's ``order`` falls in; the n - 1 bounds are approximate quantiles, fixed as literals."""
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(F.percentile_approx(order, F.array(*[F.lit(s) for s in shares]), F.lit(10 * n))).first()[0]
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    return F.size(F.filter(cuts, lambda b: b < F.col(order)))


def _offsets(d: DataFrame, name: str, value: Column, merge) -> DataFrame:
    """(range, before): ``value`` of all ranges before each; one row for each range, so its size is bounded."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("_range").agg(value.alias("_v"))
    return per.select(F.col("_range").alias("_r"), merge("_v").over(before).alias(name))


def ranked(df: DataFrame, order: str, name: str = "place", n: int = RANGES) -> DataFrame:
    """``df`` with each row's place in order of a numeric column, from 0."""
    d = df.withColumn("_range", ranges(df, order, n))
    off = _offsets(d, "_before", F.count("*"), F.sum)
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return d.withColumn("_in", inner).join(F.broadcast(off), F.col("_range") == F.col("_r")).withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_in", "_r", "_before")


def running_max_before(df: DataFrame, order: str, value: str, name: str, n: int = RANGES) -> DataFrame:
    """``df`` with the maximum of ``value`` over all rows of smaller ``order``, null for the first."""
    d = df.withColumn("_range", ranges(df, order, n))
    off = _offsets(d, "_before", F.max(value), F.max)
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_in", F.max(value).over(w)).join(F.broadcast(off), F.col("_range") == F.col("_r")).withColumn(name, F.greatest("_in", "_before")).drop("_range", "_in", "_r", "_before")
