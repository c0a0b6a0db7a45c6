"""Key-value queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.hashing import crc32c, hash_one, murmur32, super_fast_hash, super_fast_kernel
from tessera.functions.timeops import micros, seconds
from tessera.operators import kv
from tessera.plans import sql_parts
from tessera.session import table

#: Fixed instant: 2024-01-20 00:00:00 UTC.
NOW = 1_705_708_800
TTL = "CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 604800 WHEN 'signup' THEN 0 ELSE 2592000 END"


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


def state_latest(spark, d):
    log = _log(spark, d).withColumn("at", F.col("seq"))
    return kv.state(log).select("key", "value", F.col("at").alias("seq"))


def get_missing_empty(spark, d):
    e = table(spark, d, "events")
    span = e.agg(F.max("user_id").alias("m"))
    keys = span.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 5)).alias("key"))
    return kv.get(kv.state(_log(spark, d)), keys)


def _ttl_table(spark, d):
    e = table(spark, d, "events")
    ttl = F.expr(TTL)
    return kv.state(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), kv.expiry(ttl, seconds("ts")).alias("expired"), F.col("event_id").alias("seq")))


def ttl_live(spark, d):
    return kv.live(_ttl_table(spark, d), NOW).select("key", "value", "expired")


def ttl_sweep(spark, d):
    return kv.compact(_ttl_table(spark, d), NOW)[1]


def expiry_index(spark, d):
    return kv.expiry_index(_ttl_table(spark, d)).select("expired", F.size("keys").cast("long").alias("n_keys"), F.element_at("keys", 1).alias("first_key"))


def delete(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    log = e.select(F.col("user_id").alias("key"), op.alias("op"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return kv.state(log).select("key", "value")


def delete_keys(spark, d):
    e = table(spark, d, "events")
    gone = e.where("user_id % 7 = 3").select(F.col("user_id").alias("key"))
    return kv.delete(kv.state(_log(spark, d)), gone).select("key", "value")


def _customers(spark, d):
    return table(spark, d, "customer").select(F.pmod(F.col("c_custkey"), F.lit(4)).cast("long").alias("pid"), F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


def table_info(spark, d):
    return kv.table_info(_customers(spark, d)).select("pid", "size", "start_offset")


def list_page(spark, d):
    return kv.list_page(_customers(spark, d), 100, 60).select("place", "pid", "key", "value")


def list_resume(spark, d):
    return kv.list_resume(_customers(spark, d), 1, 41, 50)


def pid_superfasthash(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_name", super_fast_hash(F.col("c_name")).alias("h")).withColumn("pid", F.col("h") % 4)


def hash_murmur_crc32c(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_name", murmur32(F.col("c_name")).alias("murmur"), crc32c(F.col("c_name")).alias("crc32c"))


PLACE_HASH = hash_one(super_fast_kernel, b"orders")


def _nodes(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return s.withColumn("idx", (F.row_number().over(Window.orderBy("node")) - 1).cast("long"))


def placement(spark, d):
    p = kv.placement(8, 3, PLACE_HASH, _nodes(spark, d))
    return p.select("pid", F.col("replica").cast("long").alias("replica"), "node", "role")


def _by_nation(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("pid")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("all"))
    return s.select("pid", F.get("all", 0).alias("master"), F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))).alias("slaves"))


def failover(spark, d):
    f = kv.failover(_by_nation(spark, d), lambda x: x % 7 == 1)
    return f.select("pid", "master", F.array_join(F.transform("slaves", lambda x: x.cast("string")), ",").alias("slaves"), "status")


def failback(spark, d):
    f = kv.failover(_by_nation(spark, d), lambda x: x % 7 == 1).where("master IS NOT NULL")
    b = kv.failback(f, F.lit(1).cast("long"), F.col("pid") % 5 == 0, 3)
    return b.select("pid", "master", F.size("slaves").cast("long").alias("n_slaves"), "status")


def candidate(spark, d):
    s = table(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") < 0).alias("is_fault"))
    reps = s.select(F.col("s_nationkey").cast("long").alias("pid"), F.col("s_suppkey").alias("node"))
    flying = s.where("s_suppkey % 3 = 0").select(F.pmod(F.col("s_suppkey"), F.lit(25)).cast("long").alias("pid"), F.col("s_suppkey").alias("node"))
    return kv.candidate(nodes, reps, flying)


CUT_US = NOW * 1_000_000


def node_liveness(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), micros("ts").alias("alive_us"))
    return kv.liveness(e.where(F.col("alive_us") <= CUT_US), CUT_US, 86_400_000_000)


def node_index(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("table"))
    return kv.node_index(li).select("node", F.size("tables").cast("long").alias("n_tables"), F.element_at("tables", 1).alias("first_table"))


def version_check(spark, d):
    o = table(spark, d, "orders")
    actual = o.groupBy(F.col("o_custkey").alias("table")).agg(F.lit(1).alias("epoch"), F.count("*").alias("version"))
    claim = table(spark, d, "customer").select(F.col("c_custkey").alias("table"), F.lit(1).alias("epoch"), F.lit(10).cast("long").alias("version"))
    return kv.check_version(claim, actual)


_LAST = "SELECT user_id AS key, event_type AS value, event_id AS seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"
_EXP = f"SELECT key, value, CASE WHEN ({TTL.replace('event_type', 'value')}) > 0 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + ({TTL.replace('event_type', 'value')}) ELSE 0 END AS expired FROM ({_LAST})"
_CUST = "SELECT c_custkey % 4 AS pid, c_custkey AS key, c_name AS value FROM customer"
_GROUP = "SELECT s_nationkey AS pid, s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier"

QUERIES = {
    "kv_state_latest": state_latest,
    "kv_get_missing_empty": get_missing_empty,
    "kv_ttl_live": ttl_live,
    "kv_ttl_sweep": ttl_sweep,
    "kv_expiry_index": expiry_index,
    "kv_delete": delete,
    "kv_delete_keys": delete_keys,
    "kv_table_info": table_info,
    "kv_list_page": list_page,
    "kv_list_resume": list_resume,
    "kv_pid_superfasthash": pid_superfasthash,
    "hash_murmur_crc32c": hash_murmur_crc32c,
    "kv_placement": placement,
    "kv_failover": failover,
    "kv_failback": failback,
    "kv_candidate": candidate,
    "kv_node_liveness": node_liveness,
    "kv_node_index": node_index,
    "kv_version_check": version_check,
}

_FAIL = f"""
SELECT pid, CASE WHEN m % 7 <> 1 THEN m ELSE a[1] END AS master,
  CASE WHEN m % 7 <> 1 THEN a ELSE a[2:] END AS slaves_list,
  CASE WHEN m % 7 = 1 AND len(a) = 0 THEN 'STUCK' WHEN m % 7 = 1 OR len(a) < len(s) THEN 'SLOWDOWN' ELSE 'ACTIVE' END AS status
FROM (SELECT pid, m, s, list_filter(s, lambda x: x % 7 <> 1) AS a FROM (
  SELECT pid, max(node) FILTER (WHERE rn = 1) AS m, coalesce(list(node ORDER BY node) FILTER (WHERE rn > 1), []) AS s FROM ({_GROUP}) GROUP BY pid))
"""

ORACLES = {
    "kv_pid_superfasthash": f"SELECT c_name, h, h % 4 AS pid FROM (SELECT c_name, {sql_parts.super_fast('c_name')} AS h FROM customer)",
    "hash_murmur_crc32c": f"SELECT c_name, {sql_parts.murmur('c_name')} AS murmur, {sql_parts.crc('c_name', 0x82F63B78)} AS crc32c FROM customer",
    "kv_state_latest": f"SELECT key, value, seq FROM ({_LAST})",
    "kv_get_missing_empty": f"SELECT k.key AS key, coalesce(s.value, '') AS value FROM (SELECT unnest(range(0, (SELECT max(user_id) + 6 FROM events))) AS key) k LEFT JOIN ({_LAST}) s ON s.key = k.key",
    "kv_ttl_live": f"SELECT key, value, expired FROM ({_EXP}) WHERE expired = 0 OR expired > {NOW}",
    "kv_ttl_sweep": f"SELECT count(*) FILTER (WHERE expired = 0 OR expired > {NOW}) AS kept, count(*) FILTER (WHERE expired <> 0 AND expired <= {NOW}) AS swept FROM ({_EXP})",
    "kv_expiry_index": f"SELECT expired, count(DISTINCT key) AS n_keys, min(key) AS first_key FROM ({_EXP}) WHERE expired > 0 GROUP BY expired",
    "kv_delete": f"SELECT key, value FROM ({_LAST}) WHERE value <> 'error'",
    "kv_delete_keys": f"SELECT key, value FROM ({_LAST}) WHERE key NOT IN (SELECT user_id FROM events WHERE user_id % 7 = 3)",
    "kv_table_info": f"SELECT pid, n AS size, CAST(coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM (SELECT pid, count(*) AS n FROM ({_CUST}) GROUP BY pid)",
    "kv_list_page": f"SELECT place, pid, key, value FROM (SELECT *, row_number() OVER (ORDER BY pid, key) - 1 AS place FROM ({_CUST})) WHERE place >= 100 AND place < 160",
    "kv_list_resume": f"SELECT pid, key, value FROM ({_CUST}) WHERE pid > 1 OR (pid = 1 AND key >= 41) ORDER BY pid, key LIMIT 50",
    "kv_placement": f"WITH n AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier), c AS (SELECT count(*) AS n FROM n) SELECT p.pid AS pid, r.replica AS replica, n.node AS node, CASE WHEN r.replica = 0 THEN 'master' ELSE 'slave' END AS role FROM (SELECT unnest(range(8)) AS pid) p, (SELECT unnest(range(3)) AS replica) r, c, n WHERE r.replica < c.n AND n.idx = ({PLACE_HASH} + p.pid + r.replica) % c.n",
    "kv_failover": f"SELECT pid, master, array_to_string(slaves_list, ',') AS slaves, status FROM ({_FAIL})",
    "kv_failback": f"SELECT pid, master, n AS n_slaves, CASE WHEN 1 + n >= 3 THEN 'ACTIVE' ELSE status END AS status FROM (SELECT pid, master, status, len(slaves_list) + CASE WHEN pid % 5 = 0 AND master <> 1 AND NOT list_contains(slaves_list, 1) THEN 1 ELSE 0 END AS n FROM ({_FAIL}) WHERE master IS NOT NULL)",
    "kv_candidate": "WITH r AS (SELECT CAST(s_nationkey AS BIGINT) AS pid, s_suppkey AS node FROM supplier), f AS (SELECT s_suppkey % 25 AS pid, s_suppkey AS node FROM supplier WHERE s_suppkey % 3 = 0), u AS (SELECT * FROM r UNION ALL SELECT * FROM f), l AS (SELECT node, count(*) AS load FROM u GROUP BY node), o AS (SELECT p.pid, s.s_suppkey AS node, coalesce(l.load, 0) AS load, s.s_acctbal >= 0 AS good FROM (SELECT DISTINCT pid FROM r) p CROSS JOIN supplier s LEFT JOIN l ON l.node = s.s_suppkey WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.pid = p.pid AND u.node = s.s_suppkey)) SELECT pid, node FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY load, good, node) AS rn FROM o) WHERE rn = 1",
    "kv_node_liveness": f"SELECT user_id AS node, max(epoch_us(ts)) AS last_alive, {CUT_US} - max(epoch_us(ts)) > 86400000000 AS expired FROM events WHERE epoch_us(ts) <= {CUT_US} GROUP BY user_id",
    "kv_node_index": "SELECT l_suppkey AS node, count(DISTINCT l_orderkey) AS n_tables, min(l_orderkey) AS first_table FROM lineitem GROUP BY 1",
    "kv_version_check": "SELECT c_custkey AS \"table\", coalesce(n = 10, false) AS ok, coalesce(10 < n, false) AS behind FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
}
