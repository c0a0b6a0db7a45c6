"""Mergeable metrics, percentiles, windows over ticks and multi-resolution series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INT32 = (-(1 << 31), (1 << 31) - 1)
#: Shares of the CDF's points, in percent; the last two stand at 100 and 101.
CDF_POINTS = [*range(10, 100, 10), *range(91, 100), 99.9, 99.99]


def adder(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def maxer(x: Column, identity: float | None = None) -> Column:
    """Maximum; ``identity`` is what no value at all reads as (and, in compatible mode, a floor of all values)."""
    return F.max(x) if identity is None else F.coalesce(F.max(x), F.lit(identity))


def miner(x: Column, identity: float | None = None) -> Column:
    return F.min(x) if identity is None else F.coalesce(F.min(x), F.lit(identity))


def clamp32(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(INT32[0])), F.lit(INT32[1]))).cast("long")


def truncated_average(x: Column) -> Column:
    """Integer average of values held to 32 bits, toward zero, 0 if there are none."""
    total, n = F.sum(clamp32(x)), F.count(x)
    return F.coalesce((F.signum(total) * F.floor(F.abs(total) / n)).cast("long"), F.lit(0))


def vector_sum(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): elementwise sums; partial sums are per position, so no group is ever collected but its result."""
    d = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "s")))
    return d.groupBy(key).agg(F.transform(ordered, lambda p: p["s"]).alias(vector))


#: Width of the value ranges that ranks are counted by: 32-bit values have at most so many ranges.
RANGE = 65_536


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: int = RANGE) -> DataFrame:
    """Exact nearest-rank percentiles: the value at ceil(p * n) in order.

    Ranks come from counts of distinct values, which pre-aggregate, so a hot key doesn't move its rows. The counts
    are summed by ranges of values first; only ranges that hold a sought rank are looked into, each by itself.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c")).withColumn("r", F.floor(F.col(value) / width))
    blocks = counts.groupBy(*keys, "r").agg(F.sum("c").alias("bc"))
    w = Window.partitionBy(*keys)
    upto = F.sum("bc").over(w.orderBy("r"))
    blocks = blocks.withColumn("after", upto).withColumn("n", F.sum("bc").over(w)).withColumn("base", F.col("after") - F.col("bc"))
    rank = {name: F.ceil(F.lit(p) * F.col("n")) for name, p in shares.items()}
    sought = F.lit(False)
    for k in rank.values():
        sought = sought | ((k > F.col("base")) & (k <= F.col("after")))
    inner = counts.join(blocks.where(sought).select(*keys, "r", "base", "n"), [*keys, "r"])
    cum = inner.withColumn("upto", F.col("base") + F.sum("c").over(Window.partitionBy(*keys, "r").orderBy(value)))
    # the first value that reaches the rank; smaller ranges that were looked into end before it
    picks = [F.min(F.when(F.col("upto") >= k, F.col(value))).alias(name) for name, k in rank.items()]
    return cum.groupBy(*keys).agg(*picks)


def approximate(x: Column, p: float, accuracy: int = 10_000) -> Column:
    """The sketch form: mergeable, bounded, for streams and very many values."""
    return F.percentile_approx(x, p, accuracy)


def latency_bundle(rows: DataFrame, key: str, latency: str, elapsed_us: int) -> DataFrame:
    """Count, average, maximum, rate and percentiles of integer latencies; negatives are dropped, 32 bits held to."""
    d = rows.where(F.col(latency) >= 0).select(key, F.least(F.col(latency), F.lit(4294967295)).cast("long").alias("lat"))
    base = d.groupBy(key).agg(
        F.count("*").alias("count"),
        truncated_average(F.col("lat")).alias("avg"),
        F.max("lat").alias("max"),
        F.round(F.count("*") * F.lit(1e6) / F.lit(elapsed_us)).cast("long").alias("qps"),
    )
    ranks = nearest_rank(d, [key], "lat", {"p80": 0.8, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999})
    return base.join(ranks, key)


def cdf(rows: DataFrame, value: str) -> DataFrame:
    """(x, value): the CDF's points by nearest rank."""
    names = {f"p{i}": p / 100 for i, p in enumerate(CDF_POINTS)}
    xs = [*range(10, 100, 10), *range(91, 100), 100, 101]
    one = nearest_rank(rows.withColumn("k", F.lit(0)), ["k"], value, names)
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(n).alias("value")) for x, n in zip(xs, names, strict=True)])).alias("p")).select("p.x", "p.value")


def dense(ticks: DataFrame, keys: list[str], tick: str, values: dict[str, object], step: int = 1) -> DataFrame:
    """Ticks without gaps from the first to the last of all, missing ones filled: the sampler has a value every tick."""
    lo, hi = ticks.agg(F.min(tick), F.max(tick)).first()
    if lo is None:
        return ticks.fillna(values)
    # two numbers go to the driver; each key's ticks are made where the key is
    kind = ticks.schema[tick].dataType
    each = F.explode(F.sequence(F.lit(lo).cast(kind), F.lit(hi).cast(kind), F.lit(step))).alias(tick)
    full = ticks.select(*keys).distinct().select(*keys, each) if keys else ticks.sparkSession.range(lo, hi + 1, step).select(F.col("id").cast(kind).alias(tick))
    return full.join(ticks, [*keys, tick], "left").fillna(values)


def windowed(ticks: DataFrame, keys: list[str], tick: str, n: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the last ``n`` ticks; fewer at the start. Sums could go by difference of running sums; frames give the same."""
    if not 1 <= n <= 3600:
        raise ValueError("a window spans 1 to 3600 ticks")
    w = Window.partitionBy(*keys).orderBy(tick).rangeBetween(-(n - 1), 0)
    return ticks.select("*", *[c.over(w).alias(name) for name, c in aggs.items()])


def windowed_by_difference(ticks: DataFrame, keys: list[str], tick: str, n: int, value: str) -> DataFrame:
    """The window sum of a dense series as latest minus oldest running sum."""
    w = Window.partitionBy(*keys).orderBy(tick)
    run = F.sum(value).over(w)
    d = ticks.withColumn("running", run)
    return d.withColumn("window_sum", F.col("running") - F.coalesce(F.lag("running", n).over(w), F.lit(0))).drop("running")


def per_second(total: Column, elapsed_us: Column, integral: bool = True) -> Column:
    """Rate of a window; 0 without elapsed time; integers round half away from zero."""
    rate = total * F.lit(1e6) / F.when(elapsed_us > 0, elapsed_us)
    rate = F.coalesce(rate, F.lit(0.0))
    return F.round(rate).cast("long") if integral else rate


def rollup(series: DataFrame, keys: list[str], tick: str, value: str, group: int, addition: bool) -> DataFrame:
    """Complete groups of ``group`` ticks to one: sums average (rounded half away), maxima stay maxima."""
    d = series.withColumn("g", F.floor(F.col(tick) / group).cast("long"))
    op = F.round(F.sum(value) / F.lit(float(group))).cast("long") if addition else F.max(value)
    full = d.groupBy(*keys, "g").agg(F.count("*").alias("n"), op.alias(value)).where(F.col("n") == group)
    return full.select(*keys, F.col("g").alias(tick), value)


def trend(days: DataFrame, hours: DataFrame, minutes: DataFrame, seconds: DataFrame, tick: str, value: str) -> DataFrame:
    """(idx, value): 30 days, 24 hours, 60 minutes, 60 seconds, oldest to newest, missing ones 0."""
    out = None
    base = 0
    for part, n in ((days, 30), (hours, 24), (minutes, 60), (seconds, 60)):
        last = part.orderBy(F.col(tick).desc()).limit(n)
        w = Window.orderBy(F.col(tick).desc())
        placed = last.select((F.lit(base + n) - F.row_number().over(w)).cast("long").alias("idx"), value)
        spine = part.sparkSession.range(base, base + n).withColumnRenamed("id", "idx")
        placed = spine.join(placed, "idx", "left").fillna({value: 0})
        out = placed if out is None else out.unionByName(placed)
        base += n
    return out


def stack_fold(rows: DataFrame, stack: str, duration: str, count: Column) -> DataFrame:
    """Samples with one stack: summed durations and counts, counts rounded up."""
    return rows.groupBy(stack).agg(F.sum(duration).alias("duration"), F.ceil(F.sum(count)).cast("long").alias("n"))


def prometheus_summary(bundle: DataFrame, key: str, prefix: str, quantiles: dict[str, str]) -> DataFrame:
    """(line): text exposition of a latency bundle; the sum is average times count."""
    name = F.concat(F.lit(prefix + "_"), F.lower(F.col(key)))
    lines = [F.concat(F.lit("# TYPE "), name, F.lit(" summary"))]
    lines += [F.concat(name, F.lit('{quantile="' + q + '"} '), F.col(c).cast("string")) for c, q in quantiles.items()]
    lines += [F.concat(name, F.lit("_sum "), (F.col("avg") * F.col("count")).cast("string")), F.concat(name, F.lit("_count "), F.col("count").cast("string"))]
    return bundle.select(F.explode(F.array(*lines)).alias("line"))


def sample_adaptive(rows: DataFrame, tick: str, uniform: Column, target: int) -> DataFrame:
    """Bernoulli sample that keeps about ``target`` rows of each tick; ``uniform`` in [0, 1) decides each row."""
    n = rows.groupBy(tick).agg(F.count("*").alias("rate"))
    d = rows.join(n, tick)
    return d.where(uniform < F.least(F.lit(1.0), F.lit(float(target)) / F.col("rate"))).drop("rate")


def reduce_by(rows: DataFrame, keys: list[str], value: Column, op: Callable[[Column, Column], Column], identity: Column, name: str = "value") -> DataFrame:
    """Values of each key reduced by an associative, commutative operation: first what a task has of a key, then the tasks' results."""
    d = rows.select(*keys, value.alias("_v"), F.spark_partition_id().alias("_part"))
    fold = lambda c: F.aggregate(F.collect_list(c), identity, op)
    return d.groupBy(*keys, "_part").agg(fold("_v").alias("_v")).groupBy(*keys).agg(fold("_v").alias(name))


def stat(x: Column) -> Column:
    """(sum, num): the state of an average."""
    return F.struct(F.coalesce(F.sum(x), F.lit(0)).alias("sum"), F.count(x).alias("num"))


def merged_stat(a: Column, b: Column, unmerge: bool = False) -> Column:
    """Two states joined, or the second taken out of the first."""
    sign = -1 if unmerge else 1
    return F.struct((a["sum"] + sign * b["sum"]).alias("sum"), (a["num"] + sign * b["num"]).alias("num"))


def derived(rows: DataFrame, **metrics: Column) -> DataFrame:
    """``rows`` with metrics that are computed when they are read."""
    return rows.withColumns(metrics)


def timed(rows: DataFrame, key: str, begin: str, end: str, elapsed_us: int) -> DataFrame:
    """The latency bundle of scopes or locks, from when each began and ended."""
    return latency_bundle(rows.withColumn("_took", F.col(end) - F.col(begin)), key, "_took", elapsed_us)


def counter_bundle(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Average, maximum, count and percentiles of a counter; it has no rate."""
    return latency_bundle(rows, key, value, 1).drop("qps")


def samples(ticks: DataFrame, keys: list[str], tick: str, value: str, n: int, per_second: bool = False) -> DataFrame:
    """A series' value at each tick: over its window of ``n`` ticks, or of the tick alone."""
    return windowed(ticks, keys, tick, 1 if per_second else n, {"sample": F.sum(value)})
