"""Cellular automaton on sparse live cells, and balance pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, release


def life_step(cells: DataFrame, width: int, height: int, condition: int = 3, torus: bool = True) -> DataFrame:
    """One generation of live cells (x, y): alive if the 3x3 sum equals ``condition``, with or without the cell itself.

    Each live cell sends a count to its nine fields; the work goes with the live cells, not with the grid.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(int(i == 0 and j == 0)).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = cells.select("x", "y", F.explode(offsets).alias("o"))
    if torus:
        d = d.select(F.pmod(F.col("x") + F.col("o.dx"), F.lit(width)).alias("x"), F.pmod(F.col("y") + F.col("o.dy"), F.lit(height)).alias("y"), "o.own")
    else:
        d = d.select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "o.own").where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    g = d.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    return g.where((F.col("n") == condition) | (F.col("n") - F.col("own") == condition) & (F.col("own") == 1)).select("x", "y")


def population(cells: DataFrame, first: int | None = None, last: int | None = None) -> int:
    """Live cells, of all rows or of the band [first, last)."""
    if first is not None:
        cells = cells.where(F.col("y") >= first)
    if last is not None:
        cells = cells.where(F.col("y") < last)
    return cells.count()


def life_run(cells: DataFrame, width: int, height: int, generations: int, stagnant: int = 10) -> tuple[DataFrame, list[int]]:
    """Generations and their populations; stops early once the population stood still ``stagnant`` times."""
    seen: list[int] = []
    for _ in range(generations):
        after = materialise(life_step(cells, width, height), "life")
        release(cells)
        cells = after
        seen.append(population(cells))
        if len(seen) >= stagnant and len(set(seen[-stagnant:])) == 1:
            break
    return cells, seen


def random_cells(spark, width: int, height: int, density: float, seed: int) -> DataFrame:
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    d = spark.range(width * height).where(u < density)
    return d.select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def render(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(y, line): rows of the grid as text, # for live."""
    rows = cells.groupBy("y").agg(F.collect_set("x").alias("xs"))
    spine = cells.sparkSession.range(height).select(F.col("id").cast("int").alias("y"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.when(F.array_contains(F.coalesce("xs", F.array().cast("array<int>")), x), "#").otherwise(".")), "")
    return spine.join(rows, "y", "left").select("y", text.alias("line"))


def grow(kind: str, x: Column, y: Column, coeff: Column, integral: bool = False) -> tuple[Column, Column]:
    """The balance step: SUM moves coeff from x to y, PROD divides x and multiplies y."""
    if kind == "sum":
        return x - coeff, y + coeff
    quotient = x / coeff
    if integral:
        quotient = (F.signum(quotient) * F.floor(F.abs(quotient))).cast("long")
    return quotient, y * coeff


def connection(kind: str, x: Column, y: Column) -> Column:
    return y - x if kind == "sum" else y / x
