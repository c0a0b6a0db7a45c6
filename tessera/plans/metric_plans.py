"""Metrics, windows and series over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathops import log2_bucket
from tessera.functions.timeops import HOUR, micros
from tessera.operators import metrics as m
from tessera.session import table

SECOND30 = 30 * 86_400_000_000


def adder(spark, d):
    e = table(spark, d, "events")
    v = F.floor(F.col("value")).cast("long")
    return e.groupBy("event_type").agg(m.adder(v).alias("total"), F.count("value").alias("num"))


def extremes(spark, d):
    li = table(spark, d, "lineitem")
    q = F.floor("l_extendedprice").cast("long")
    return li.groupBy("l_returnflag").agg(m.maxer(q).alias("high"), m.miner(q).alias("low"), m.truncated_average(q).alias("mean"))


def average_negative(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(m.truncated_average(F.floor(F.col("c_acctbal") * 1e6).cast("long") - 3_000_000_000).alias("mean"))


def vector_sum(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    return m.vector_sum(e, "label", "v").select("label", F.posexplode("v").alias("pos", "s")).select("label", "pos", F.col("s").cast("long").alias("s"))


def _lat(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", F.floor(F.col("l_extendedprice") * 100).cast("long").alias("lat"))


def latency_bundle(spark, d):
    return m.latency_bundle(_lat(spark, d), "l_returnflag", "lat", SECOND30)


def cdf(spark, d):
    o = table(spark, d, "orders").select(F.floor("o_totalprice").cast("long").alias("v"))
    return m.cdf(o, "v")


def log2_hist(spark, d):
    o = table(spark, d, "orders").select(F.floor("o_totalprice").cast("long").alias("v"))
    return o.groupBy(log2_bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def last_value(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def prometheus(spark, d):
    b = m.latency_bundle(_lat(spark, d), "l_returnflag", "lat", SECOND30)
    return m.prometheus_summary(b, "l_returnflag", "price", {"p80": "0.8", "p99": "0.99", "p9999": "0.9999"})


def stack_fold(spark, d):
    e = table(spark, d, "events").withColumn("dur", F.floor("value").cast("long"))
    return m.stack_fold(e, "event_type", "dur", F.lit(0.25))


def _ticks(spark, d, extra=()):
    e = table(spark, d, "events").select("event_type", F.floor(micros("ts") / HOUR).cast("long").alias("tick"), F.floor("value").cast("long").alias("v"))
    t = e.groupBy("event_type", "tick").agg(F.sum("v").alias("s"), F.max("v").alias("mx"), F.count("*").alias("n"))
    return m.dense(t, ["event_type"], "tick", {"s": 0, "mx": 0, "n": 0})


def window_sum(spark, d):
    w = m.windowed(_ticks(spark, d), ["event_type"], "tick", 10, {"w_sum": F.sum("s"), "w_n": F.sum("n")})
    return w.select("event_type", "tick", "w_sum", "w_n")


def window_difference(spark, d):
    w = m.windowed_by_difference(_ticks(spark, d), ["event_type"], "tick", 10, "s")
    return w.select("event_type", "tick", "window_sum")


def window_max(spark, d):
    w = m.windowed(_ticks(spark, d), ["event_type"], "tick", 24, {"w_max": F.max("mx")})
    return w.select("event_type", "tick", "w_max")


def window_rate(spark, d):
    w = m.windowed(_ticks(spark, d), ["event_type"], "tick", 10, {"w_sum": F.sum("s"), "w_n": F.sum("n"), "k": F.count("*")})
    us = F.col("k") * HOUR
    return w.select("event_type", "tick", m.per_second(F.col("w_sum") * 1000, us).alias("rate"), m.per_second(F.col("w_n") * 1000, us).alias("qps"))


def window_samples(spark, d):
    w = m.windowed(_ticks(spark, d), ["event_type"], "tick", 5, {"samples": F.collect_list("s")})
    return w.select("event_type", "tick", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


def rollup_day(spark, d):
    return m.rollup(_ticks(spark, d), ["event_type"], "tick", "s", 24, True)


def rollup_day_max(spark, d):
    return m.rollup(_ticks(spark, d), ["event_type"], "tick", "mx", 24, False)


def trend(spark, d):
    hours = m.dense(_ticks(spark, d).groupBy("tick").agg(F.sum("s").alias("s")), [], "tick", {"s": 0})
    days = m.rollup(hours, [], "tick", "s", 24, True)
    none = hours.where("false")
    return m.trend(days, hours, none, none, "tick", "s")


def adaptive_sample(spark, d):
    e = table(spark, d, "events").withColumn("day", F.floor(micros("ts") / (24 * HOUR)).cast("long"))
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return m.sample_adaptive(e, "day", u, 100).select("event_id", "day")


_TICKS = """
t AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS tick, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS s, max(CAST(floor(value) AS BIGINT)) AS mx, count(*) AS n FROM events GROUP BY 1, 2),
spine AS (SELECT event_type, tick FROM (SELECT DISTINCT event_type FROM t), (SELECT unnest(range((SELECT min(tick) FROM t), (SELECT max(tick) + 1 FROM t))) AS tick)),
f AS (SELECT event_type, tick, coalesce(s, 0) AS s, coalesce(mx, 0) AS mx, coalesce(n, 0) AS n FROM spine LEFT JOIN t USING (event_type, tick))"""
_FRAME = "OVER (PARTITION BY event_type ORDER BY tick RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
_RANKS = ", ".join(f"min(lat) FILTER (WHERE rn >= ceil({p} * n)) AS {k}" for k, p in {"p80": 0.8, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}.items())
_BUNDLE = f"SELECT l_returnflag, count(*) AS count, CAST(trunc(sum(least(lat, 2147483647)) / count(*)) AS BIGINT) AS avg, max(lat) AS max, CAST(round(count(*) * 1e6 / {SECOND30}) AS BIGINT) AS qps, {_RANKS} FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY lat) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT l_returnflag, CAST(floor(l_extendedprice * 100) AS BIGINT) AS lat FROM lineitem)) GROUP BY l_returnflag"
_XS = [*range(10, 100, 10), *range(91, 100), 100, 101]

QUERIES = {
    "metric_adder": adder,
    "metric_max_min_avg": extremes,
    "metric_avg_clamped": average_negative,
    "metric_vector_sum": vector_sum,
    "metric_latency_bundle": latency_bundle,
    "metric_cdf": cdf,
    "metric_log2_hist": log2_hist,
    "metric_last_value": last_value,
    "metric_prometheus": prometheus,
    "metric_stack_fold": stack_fold,
    "window_sum": window_sum,
    "window_sum_by_difference": window_difference,
    "window_max": window_max,
    "window_rate_qps": window_rate,
    "window_samples": window_samples,
    "series_rollup_day": rollup_day,
    "series_rollup_day_max": rollup_day_max,
    "series_trend": trend,
    "sample_adaptive": adaptive_sample,
}
ORACLES = {
    "metric_adder": "SELECT event_type, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS total, count(value) AS num FROM events GROUP BY 1",
    "metric_max_min_avg": "SELECT l_returnflag, max(q) AS high, min(q) AS low, CAST(trunc(sum(q) / count(*)) AS BIGINT) AS mean FROM (SELECT l_returnflag, CAST(floor(l_extendedprice) AS BIGINT) AS q FROM lineitem) GROUP BY 1",
    "metric_avg_clamped": "SELECT c_mktsegment, CAST(sum(x) // count(*) + CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 AND (sum(x) // count(*)) * count(*) > sum(x) THEN 1 ELSE 0 END AS BIGINT) AS mean FROM (SELECT c_mktsegment, least(greatest(CAST(floor(c_acctbal * 1e6) AS BIGINT) - 3000000000, -2147483648), 2147483647) AS x FROM customer) GROUP BY 1",
    "metric_vector_sum": "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, CAST(sum(floor(CAST(embedding[pos] AS DOUBLE) * 1000)) AS BIGINT) AS s FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos",
    "metric_latency_bundle": _BUNDLE,
    "metric_cdf": "WITH v AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (ORDER BY floor(o_totalprice)) AS rn, count(*) OVER () AS n FROM orders) " + " UNION ALL ".join(f"SELECT {x} AS x, min(v) FILTER (WHERE rn >= ceil({p / 100} * n)) AS value FROM v" for x, p in zip(_XS, m.CDF_POINTS, strict=True)),
    "metric_log2_hist": "SELECT CAST(CASE WHEN v <= 2 THEN 0 WHEN v > 4294967295 THEN 31 ELSE length(bin(v)) - 2 END AS INTEGER) AS bucket, count(*) AS n FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) GROUP BY 1",
    "metric_last_value": "SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "metric_prometheus": f"WITH b AS ({_BUNDLE}), l AS (SELECT 'price_' || lower(l_returnflag) AS name, * FROM b) SELECT unnest(['# TYPE ' || name || ' summary', name || '{{quantile=\"0.8\"}} ' || p80, name || '{{quantile=\"0.99\"}} ' || p99, name || '{{quantile=\"0.9999\"}} ' || p9999, name || '_sum ' || CAST(avg * count AS BIGINT), name || '_count ' || count]) AS line FROM l",
    "metric_stack_fold": "SELECT event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duration, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM events GROUP BY 1",
    "window_sum": f"WITH {_TICKS} SELECT event_type, tick, CAST(sum(s) {_FRAME.format(9)} AS BIGINT) AS w_sum, CAST(sum(n) {_FRAME.format(9)} AS BIGINT) AS w_n FROM f",
    "window_sum_by_difference": f"WITH {_TICKS} SELECT event_type, tick, CAST(sum(s) {_FRAME.format(9)} AS BIGINT) AS window_sum FROM f",
    "window_max": f"WITH {_TICKS} SELECT event_type, tick, max(mx) {_FRAME.format(23)} AS w_max FROM f",
    "window_rate_qps": f"WITH {_TICKS} SELECT event_type, tick, CAST(round(ws * 1000 * 1e6 / (k * 3600000000)) AS BIGINT) AS rate, CAST(round(wn * 1000 * 1e6 / (k * 3600000000)) AS BIGINT) AS qps FROM (SELECT event_type, tick, sum(s) {_FRAME.format(9)} AS ws, sum(n) {_FRAME.format(9)} AS wn, count(*) {_FRAME.format(9)} AS k FROM f)",
    "window_samples": f"WITH {_TICKS} SELECT event_type, tick, array_to_string(list(s) OVER (PARTITION BY event_type ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS samples FROM f",
    "series_rollup_day": f"WITH {_TICKS} SELECT event_type, tick // 24 AS tick, CAST(round(sum(s) / 24.0) AS BIGINT) AS s FROM f GROUP BY 1, 2 HAVING count(*) = 24",
    "series_rollup_day_max": f"WITH {_TICKS} SELECT event_type, tick // 24 AS tick, max(mx) AS mx FROM f GROUP BY 1, 2 HAVING count(*) = 24",
    "series_trend": f"WITH {_TICKS}, h AS (SELECT tick, sum(s) AS s FROM f GROUP BY 1), dy AS (SELECT tick // 24 AS tick, CAST(round(sum(s) / 24.0) AS BIGINT) AS s FROM h GROUP BY 1 HAVING count(*) = 24), p AS (SELECT 30 - row_number() OVER (ORDER BY tick DESC) AS idx, s FROM (SELECT * FROM dy ORDER BY tick DESC LIMIT 30) UNION ALL SELECT 54 - row_number() OVER (ORDER BY tick DESC) AS idx, s FROM (SELECT * FROM h ORDER BY tick DESC LIMIT 24)) SELECT i.idx AS idx, CAST(coalesce(p.s, 0) AS BIGINT) AS s FROM (SELECT unnest(range(174)) AS idx) i LEFT JOIN p ON p.idx = i.idx",
    "sample_adaptive": "SELECT event_id, day FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u, count(*) OVER (PARTITION BY floor(epoch_us(ts) / 86400000000)) AS rate FROM events) WHERE u < least(1.0, 100.0 / rate)",
}
