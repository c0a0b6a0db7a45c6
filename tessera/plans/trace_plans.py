"""Traces, sets, filters, rules and assignment over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import strings as st
from tessera.functions.hashing import md5_word, murmur32
from tessera.functions.timeops import micros
from tessera.operators import assign, trace
from tessera.plans import sql_parts
from tessera.session import table

START = 1_705_708_800_000_000


def _spans(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.when(F.col("event_id") > 0, F.col("event_id") - 1).alias("parent_span_id"),
        micros("ts").alias("start_us"),
        F.floor("value").cast("long").alias("latency_us"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("error_code"),
    )


def span_list(spark, d):
    return trace.list_spans(_spans(spark, d), START, 500, trace.span_filter(20, error_code=1)).select("span_id", "latency_us")


def span_by_trace(spark, d):
    return trace.find_spans(_spans(spark, d), 7).select("trace_id", "span_id", "latency_us")


def span_tree(spark, d):
    return trace.assemble(_spans(spark, d))


def span_retention(spark, d):
    return trace.retain(_spans(spark, d), START, 3_600_000_000 * 24).select("span_id")


def _parts(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_linenumber = 1").select("l_partkey")
    return a, li.where("l_linenumber = 2").select("l_partkey")


def set_except(spark, d):
    a, b = _parts(spark, d)
    return a.exceptAll(b)


def set_intersect(spark, d):
    a, b = _parts(spark, d)
    return a.intersectAll(b)


def set_union(spark, d):
    return trace.multiset_union(*_parts(spark, d))


def set_includes(spark, d):
    a, b = _parts(spark, d)
    return trace.includes(a.unionAll(b), b)


def keep_first(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return trace.keep_first(e, ["user_id", "event_type"], "event_id")


def server_diff(spark, d):
    s = table(spark, d, "supplier")
    return trace.snapshot_diff(s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 5 <> 0"), "s_suppkey")


def conf_asof(spark, d):
    """As of a configuration's index: the largest open order's day per customer before each later day."""
    o = table(spark, d, "orders").select("o_custkey", F.floor(micros("o_orderdate") / 86_400_000_000).cast("long").alias("day"), "o_totalprice")
    daily = o.groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("top"))
    return trace.as_of_backward(daily, daily, ["o_custkey"], "day", "top").select("o_custkey", "day", "prev_top")


def mru_topn(spark, d):
    return trace.mru(table(spark, d, "events"), "user_id", "event_id", 10)


RULES = ["/en/*", "/en/1*", "/fr/*", "/*.html", "/de/*/"]


def rule_match(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return trace.match_rules(p, "path", RULES)


def filter_wildcard(spark, d):
    p = table(spark, d, "part")
    return p.where(st.wildcard_list(F.col("p_name"), "*red*,part_1?;Part#1", False) | st.wildcard_list(F.col("p_brand"), "Brand#1*,Brand#22")).select("p_partkey", "p_name")


def filter_white_black(spark, d):
    p = table(spark, d, "part")
    keep = st.wildcard_list(F.col("p_type"), "*", True) & ~st.wildcard_list(F.col("p_brand"), "Brand#1*;Brand#3?")
    return p.where(keep).select("p_partkey", "p_brand")


def filter_glob(spark, d):
    p = table(spark, d, "part")
    return p.where(st.match_pattern(F.col("p_brand"), "Brand#?2?") | st.match_pattern(F.col("p_name"), "*1\\0")).select("p_partkey")


def filter_bits(spark, d):
    return table(spark, d, "part").where(F.col("p_size").bitwiseAND(12) != 0).select("p_partkey", "p_size")


def exclude_tried(spark, d):
    s = table(spark, d, "supplier")
    tried = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber = 3").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(tried.distinct(), "s_suppkey", "left_anti").select("s_suppkey")


def _requests(spark, d):
    return table(spark, d, "orders").select("o_orderkey", md5_word(F.col("o_orderkey").cast("string")).alias("code"))


def ring_md5(spark, d):
    s = table(spark, d, "supplier")
    return assign.lookup(_requests(spark, d), "code", assign.ring(s, "s_suppkey", md5_word)).select("o_orderkey", "server")


def ring_ketama(spark, d):
    s = table(spark, d, "supplier")
    return assign.lookup(_requests(spark, d), "code", assign.ketama_ring(s, "s_suppkey", md5_word)).select("o_orderkey", "server")


def ring_murmur(spark, d):
    s = table(spark, d, "supplier")
    r = table(spark, d, "orders").select("o_orderkey", murmur32(F.col("o_orderkey").cast("string")).alias("code"))
    return assign.lookup(r, "code", assign.ring(s, "s_suppkey", murmur32)).select("o_orderkey", "server")


def _servers(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("server"), (F.col("n_regionkey") + 1).cast("long").alias("weight"))


def wrr(spark, d):
    n = 75 * 4
    r = spark.range(n).withColumnRenamed("id", "i")
    return assign.weighted_round_robin(r, "i", _servers(spark, d)).groupBy("server").agg(F.count("*").alias("n"))


def rr(spark, d):
    r = table(spark, d, "orders").select("o_orderkey")
    return assign.round_robin(r, "o_orderkey", 25, 3, 5).groupBy("server").agg(F.count("*").alias("n"))


def pick(spark, d):
    u = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return assign.weighted_pick(table(spark, d, "orders").select("o_orderkey"), u, _servers(spark, d)).select("o_orderkey", "server")


def partition_tags(spark, d):
    t = table(spark, d, "lineitem").select(F.concat_ws("/", (F.col("l_orderkey") % 5).cast("string"), F.col("l_linenumber").cast("string")).alias("tag"))
    p = t.select(assign.partition_tag(F.col("tag")).alias("p")).where("p.total = 3 AND p.index < p.total")
    return p.groupBy(F.col("p.index").alias("idx")).agg(F.count("*").alias("n"))


def scatter(spark, d):
    li = table(spark, d, "lineitem")
    calls = li.groupBy("l_orderkey", F.pmod("l_partkey", F.lit(4)).alias("pid")).agg(F.sum(F.floor("l_quantity")).alias("q"), F.max((F.col("l_discount") > 0.09).cast("int")).alias("bad"))
    return assign.scatter_gather(calls, "l_orderkey", F.col("bad") == 1, F.col("q"), 2)


def recover(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.when(F.col("s_acctbal") > 0, 1)).alias("usable"), F.count("*").alias("n"))
    return s.select("s_nationkey", F.round(assign.reject_rate(F.col("usable"), F.col("n") * 1.0), 6).alias("rate"))


_RING = "ring AS (SELECT p, min(s) AS s FROM ({}) GROUP BY p)"
_WORD = "CAST('0x' || substr(m, {0} + 6, 2) || substr(m, {0} + 4, 2) || substr(m, {0} + 2, 2) || substr(m, {0}, 2) AS BIGINT)"
_REQ = f"req AS (SELECT o_orderkey, {_WORD.format(1)} AS code FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders))"
_LOOK = "SELECT o_orderkey, coalesce(ring.s, (SELECT s FROM ring ORDER BY p LIMIT 1)) AS server FROM req ASOF LEFT JOIN ring ON req.code <= ring.p"
_NODES = "SELECT s_suppkey AS s, md5(s_suppkey || '-' || i) AS m FROM supplier, (SELECT unnest(range({})) AS i)"
_A = "SELECT l_partkey FROM lineitem WHERE l_linenumber = 1"
_B = "SELECT l_partkey FROM lineitem WHERE l_linenumber = 2"

QUERIES = {
    "span_list": span_list,
    "span_by_trace": span_by_trace,
    "span_tree": span_tree,
    "span_retention": span_retention,
    "set_except": set_except,
    "set_intersect": set_intersect,
    "set_union": set_union,
    "set_includes": set_includes,
    "distinct_keep_first": keep_first,
    "server_diff": server_diff,
    "conf_asof": conf_asof,
    "mru_topn": mru_topn,
    "rule_match": rule_match,
    "filter_wildcard": filter_wildcard,
    "filter_white_black": filter_white_black,
    "filter_glob": filter_glob,
    "filter_bits": filter_bits,
    "exclude_tried": exclude_tried,
    "ring_lookup_md5": ring_md5,
    "ring_lookup_ketama": ring_ketama,
    "ring_lookup_murmur": ring_murmur,
    "wrr_assign": wrr,
    "rr_assign": rr,
    "weighted_pick": pick,
    "partition_tags": partition_tags,
    "scatter_gather": scatter,
    "cluster_recover": recover,
}
ORACLES = {
    "span_list": f"SELECT span_id, latency_us FROM (SELECT event_id AS span_id, CAST(floor(value) AS BIGINT) AS latency_us, event_type FROM events WHERE epoch_us(ts) <= {START} ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE latency_us >= 20 AND event_type = 'error'",
    "span_by_trace": "SELECT user_id AS trace_id, event_id AS span_id, CAST(floor(value) AS BIGINT) AS latency_us FROM events WHERE user_id = 7",
    "span_tree": "SELECT c.user_id AS trace_id, c.event_id AS span_id, CASE WHEN c.event_id > 0 THEN c.event_id - 1 END AS parent_span_id, CAST(floor(p.value) AS BIGINT) AS parent_latency_us FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND c.event_id > 0 AND p.event_id = c.event_id - 1",
    "span_retention": f"SELECT event_id AS span_id FROM events WHERE epoch_us(ts) >= {START - 3_600_000_000 * 24}",
    "set_except": f"{_A} EXCEPT ALL {_B}",
    "set_intersect": f"{_A} INTERSECT ALL {_B}",
    "set_union": f"SELECT l_partkey FROM (SELECT l_partkey, greatest(count(*) FILTER (WHERE l_linenumber = 1), count(*) FILTER (WHERE l_linenumber = 2)) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), LATERAL (SELECT unnest(range(n)))",
    "set_includes": "SELECT true AS includes",
    "distinct_keep_first": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "server_diff": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'added' ELSE 'removed' END AS change FROM supplier WHERE (s_suppkey % 3 <> 0) <> (s_suppkey % 5 <> 0)",
    "conf_asof": "WITH d AS (SELECT o_custkey, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS day, max(o_totalprice) AS top FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.day, b.top AS prev_top FROM d a ASOF LEFT JOIN d b ON a.o_custkey = b.o_custkey AND a.day > b.day",
    "mru_topn": "SELECT user_id, max(event_id) AS last_touch FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "rule_match": r"SELECT page_id, path, CASE WHEN starts_with(path, '/en/1') THEN '/en/1*' WHEN starts_with(path, '/de/') AND ends_with(path, '/') AND length(path) >= 5 THEN '/de/*/' WHEN starts_with(path, '/en/') THEN '/en/*' WHEN starts_with(path, '/fr/') THEN '/fr/*' WHEN starts_with(path, '/') AND ends_with(path, '.html') THEN '/*.html' END AS rule FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)",
    "filter_wildcard": r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR regexp_full_match(p_name, 'part_1.') OR p_name = 'Part#1' OR p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#22'",
    "filter_white_black": "SELECT p_partkey, p_brand FROM part WHERE NOT (p_brand LIKE 'Brand#1%' OR regexp_full_match(p_brand, 'Brand#3.'))",
    "filter_glob": "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#.?2.?') OR p_name LIKE '%10'",
    "filter_bits": "SELECT p_partkey, p_size FROM part WHERE (p_size & 12) <> 0",
    "exclude_tried": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber = 3)",
    "ring_lookup_md5": f"WITH {_REQ}, {_RING.format('SELECT s, ' + _WORD.format(1) + ' AS p FROM (' + _NODES.format(100) + ')')} {_LOOK}",
    "ring_lookup_murmur": f"WITH req AS (SELECT o_orderkey, {sql_parts.murmur('CAST(o_orderkey AS VARCHAR)')} AS code FROM orders), {_RING.format('SELECT s, ' + sql_parts.murmur('name') + ' AS p FROM (SELECT s_suppkey AS s, s_suppkey || chr(45) || i AS name FROM supplier, (SELECT unnest(range(100)) AS i))')} {_LOOK}",
    "ring_lookup_ketama": f"WITH {_REQ}, {_RING.format(' UNION ALL '.join('SELECT s, ' + _WORD.format(1 + 8 * k) + ' AS p FROM (' + _NODES.format(25) + ')' for k in range(4)))} {_LOOK}",
    "wrr_assign": "SELECT n_nationkey AS server, CAST((n_regionkey + 1) * 4 AS BIGINT) AS n FROM nation",
    "rr_assign": "SELECT (3 + 6 * (o_orderkey + 1)) % 25 AS server, count(*) AS n FROM orders GROUP BY 1",
    "weighted_pick": "WITH s AS (SELECT n_nationkey AS server, CAST(sum(n_regionkey + 1) OVER (ORDER BY n_nationkey) AS DOUBLE) / sum(n_regionkey + 1) OVER () AS hi, CAST(n_regionkey + 1 AS DOUBLE) / sum(n_regionkey + 1) OVER () AS w FROM nation), r AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders) SELECT o_orderkey, server FROM r, s WHERE u >= hi - w AND u < hi",
    "partition_tags": "SELECT CAST(l_orderkey % 5 AS INTEGER) AS idx, count(*) AS n FROM lineitem WHERE l_linenumber = 3 AND l_orderkey % 5 < 3 GROUP BY 1",
    "scatter_gather": "SELECT l_orderkey, CAST(coalesce(sum(q) FILTER (WHERE bad = 0), 0) AS BIGINT) AS value, CAST(sum(bad) AS BIGINT) AS failures, sum(bad) < least(2, count(*)) AS ok FROM (SELECT l_orderkey, l_partkey % 4 AS pid, sum(CAST(floor(l_quantity) AS BIGINT)) AS q, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "cluster_recover": "SELECT s_nationkey, round(greatest(0.0, 1.0 - count(*) FILTER (WHERE s_acctbal > 0) / CAST(count(*) AS DOUBLE)), 6) AS rate FROM supplier GROUP BY 1",
}
