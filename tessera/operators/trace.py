"""Trace spans, set operations on snapshots, as-of joins, rule matching and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def list_spans(spans: DataFrame, start_us: int, max_scan: int, keep: Column, limit: int = 10_000) -> DataFrame:
    """The newest ``max_scan`` spans up to ``start_us``, then filtered: what is bounded is the scan and not the result."""
    n = min(max(max_scan, 1), limit)
    return spans.where(F.col("start_us") <= start_us).orderBy(F.col("start_us").desc(), F.col("span_id").desc()).limit(n).where(keep)


def span_filter(min_latency: int = 0, min_request: int = 0, min_response: int = 0, log_id: int | None = None, error_code: int | None = None) -> Column:
    test = F.col("latency_us") >= min_latency
    if min_request:
        test &= F.col("request_size") >= min_request
    if min_response:
        test &= F.col("response_size") >= min_response
    if log_id is not None:
        test &= F.col("log_id") == log_id
    if error_code is not None:
        test &= F.col("error_code") == error_code
    return test


def find_spans(spans: DataFrame, trace_id: int) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("span_id")


def assemble(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_span_id, parent_latency_us): each span beside its parent in its trace."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("latency_us").alias("parent_latency_us"))
    return spans.join(p, ["trace_id", "parent_span_id"], "left").select("trace_id", "span_id", "parent_span_id", "parent_latency_us")


def retain(spans: DataFrame, now_us: int, keep_us: int) -> DataFrame:
    return spans.where(F.col("start_us") >= now_us - keep_us)


def keep_first(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The first row of each key in order of place, as a partially aggregated minimum."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), place).alias("r")).select(*keys, "r.*")


def snapshot_diff(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, change): added and removed keys between two snapshots, by one full outer join."""
    n = new.select(key).distinct().withColumn("in_new", F.lit(True))
    o = old.select(key).distinct().withColumn("in_old", F.lit(True))
    d = n.join(o, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
    return d.select(key, change.alias("change")).where("change IS NOT NULL")


def multiset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each element max(m, n) times."""
    return a.unionAll(b.exceptAll(a))


def includes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(includes): whether ``a`` holds every element of ``b`` as often."""
    return b.exceptAll(a).agg((F.count("*") == 0).alias("includes"))


def as_of_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The latest ``value`` of ``right`` strictly before ``at``, by one union and a frame: no range join."""
    l = left.withColumn("_kind", F.lit(0)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    r = right.select(*keys, at, F.col(value).alias("_v")).withColumn("_kind", F.lit(1))
    u = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return u.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_kind = 0").drop("_kind", "_v").withColumnRenamed("_found", f"prev_{value}")


def mru(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The ``n`` keys touched last, newest first."""
    return rows.groupBy(key).agg(F.max(seq).alias("last_touch")).orderBy(F.col("last_touch").desc(), key).limit(n)


def mru_state(ops: DataFrame, key: str, seq: str, op: str, n: int) -> DataFrame:
    """The ``n`` keys touched last, newest first, after puts, gets, peeks and erases in order: a peek is no touch, and an erased key is gone until it is put again."""
    touch = F.max(F.when(F.col(op).isin("put", "get"), F.col(seq)))
    put, gone = F.max(F.when(F.col(op) == "put", F.col(seq))), F.max(F.when(F.col(op) == "erase", F.col(seq)))
    g = ops.groupBy(key).agg(touch.alias("last_touch"), put.alias("_put"), gone.alias("_gone"))
    return g.where("_put IS NOT NULL AND (_gone IS NULL OR _put > _gone)").select(key, "last_touch").orderBy(F.col("last_touch").desc(), key).limit(n)


def is_sorted(rows: DataFrame, place: str, value: str) -> DataFrame:
    """(is_sorted): whether values never fall in order of a numeric place; by ranges, no task holds all rows."""
    from tessera.operators.ranking import running_max_before

    d = rows.select(F.col(place).alias("_place"), F.col(value).alias("_value"))
    return running_max_before(d, "_place", "_value", "_high").agg((F.count(F.when(F.col("_high") > F.col("_value"), 1)) == 0).alias("is_sorted"))


def match_rules(rows: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """``rows`` with the most specific rule ``prefix*postfix`` (or exact path) that fits, null if none.

    The rules are a fixed list, turned into one expression: longest prefix first, then longest postfix.
    """
    split = [tuple(r.split("*", 1)) if "*" in r else (r, None) for r in rules]
    order = sorted(split, key=lambda r: (r[1] is not None, -len(r[0]), -len(r[1] or "")))
    rule = None
    for prefix, postfix in order:
        fits = F.col(path) == prefix if postfix is None else F.col(path).startswith(prefix) & F.col(path).endswith(postfix) & (F.length(path) >= len(prefix) + len(postfix))
        name = F.lit(prefix if postfix is None else f"{prefix}*{postfix}")
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
    return rows.withColumn("rule", rule)
