"""Key-value tables: an operation log folded to state, with TTL, batch reads, paged scans and placement.

A table is an append-only log of (seq, op, key, value, expired); its state is the
last operation of each key. ``expired`` is an absolute epoch second, 0 for never.
``now`` is always a parameter. Parquet has no row updates, so writes append and
``compact`` rewrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expiry(ttl: Column, now: Column) -> Column:
    """Absolute expiry of a relative TTL; 0 or less never expires, and clears an earlier one as the record is replaced."""
    return F.when(ttl > 0, now + ttl).otherwise(F.lit(0)).cast("long")


def state(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The last operation of every key, deletes left out: one partially aggregated group-by."""
    fields = [c for c in log.columns if c not in ("key", seq)]
    last = log.groupBy("key").agg(F.max_by(F.struct(*fields), seq).alias("r"))
    out = last.select("key", "r.*")
    return out.where("op = 'set'").drop("op") if "op" in fields else out


def live(table: DataFrame, now: int) -> DataFrame:
    return table.where((F.col("expired") == 0) | (F.col("expired") > now))


def get(table: DataFrame, keys: DataFrame, now: int | None = None) -> DataFrame:
    """Every requested key once; missing and expired ones read as an empty value."""
    found = live(table, now) if now is not None else table
    return keys.select("key").distinct().join(found.select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"))


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key").distinct(), "key", "left_anti")


def compact(table: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The sweep: live rows to be kept, and counts of kept and swept rows."""
    gone = (F.col("expired") != 0) & (F.col("expired") <= now)
    return live(table, now), table.agg(F.count(F.when(~gone, 1)).alias("kept"), F.count(F.when(gone, 1)).alias("swept"))


def expiry_index(table: DataFrame) -> DataFrame:
    """(expired, keys): keys by expiry second, never-expiring ones left out."""
    return table.where("expired > 0").groupBy("expired").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def table_info(rows: DataFrame) -> DataFrame:
    """(pid, size, start_offset): rows of each partition, expired ones included, and the rows before it."""
    sizes = rows.groupBy("pid").agg(F.count("*").alias("size"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start_offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def list_page(rows: DataFrame, offset: int, size: int, now: int | None = None) -> DataFrame:
    """The page [offset, offset + size) in order of (pid, key); expired rows take up places but aren't shown.

    Cumulative partition sizes say which partitions the page touches; only those are ranked, each by itself.
    """
    info = table_info(rows).where((F.col("start_offset") < offset + size) & (F.col("start_offset") + F.col("size") > offset))
    touched = rows.join(F.broadcast(info.select("pid", "start_offset")), "pid")
    place = F.row_number().over(Window.partitionBy("pid").orderBy("key")) - 1 + F.col("start_offset")
    page = touched.withColumn("place", place).where((F.col("place") >= offset) & (F.col("place") < offset + size))
    return (live(page, now) if now is not None else page).drop("start_offset")


def list_end(total: int, offset: int, size: int) -> bool:
    return offset + size >= total


def list_resume(rows: DataFrame, last_pid: int, last_key, size: int) -> DataFrame:
    """The next page from the first row not yet returned: keyset pagination, a top-n without ranking."""
    later = (F.col("pid") > last_pid) | ((F.col("pid") == last_pid) & (F.col("key") >= F.lit(last_key)))
    return rows.where(later).orderBy("pid", "key").limit(size)


def placement(n_partitions: int, n_replicas: int, table_hash: int, nodes: DataFrame) -> DataFrame:
    """(pid, replica, node, role): replica j of partition i goes to node (hash + i + j) mod N; replica 0 is the master.

    ``nodes`` is (idx, node), idx from 0. The number of replicas is held to 1..5 and to the number of nodes.
    """
    spark = nodes.sparkSession
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    d = spark.range(n_partitions).select(F.col("id").alias("pid")).join(n)
    replicas = F.least(F.greatest(F.lit(n_replicas), F.lit(1)), F.lit(5), F.col("n"))
    d = d.select("pid", "n", F.explode(F.sequence(F.lit(0).cast("long"), replicas.cast("long") - 1)).alias("replica"))
    d = d.withColumn("idx", F.pmod(F.lit(table_hash) + F.col("pid") + F.col("replica"), F.col("n")))
    return d.join(nodes, "idx").select("pid", "replica", "node", F.when(F.col("replica") == 0, "master").otherwise("slave").alias("role"))


def failover(partitions: DataFrame, dead: Column) -> DataFrame:
    """Partitions (pid, master, slaves) after nodes died: the first slave left takes over.

    ``dead`` is a boolean over element ``x``, as a function of a column. A partition that lost a replica is
    SLOWDOWN, one without master left is STUCK.
    """
    alive = F.filter("slaves", lambda x: ~dead(x))
    lost = dead(F.col("master"))
    master = F.when(~lost, F.col("master")).otherwise(F.get(alive, 0))
    slaves = F.when(~lost, alive).otherwise(F.when(F.size(alive) > 0, F.slice(alive, 2, F.greatest(F.size(alive), F.lit(1)))).otherwise(alive))
    status = F.when(lost & (F.size(alive) == 0), "STUCK").when(lost | (F.size(alive) < F.size("slaves")), "SLOWDOWN").otherwise("ACTIVE")
    return partitions.select("pid", master.alias("master"), slaves.alias("slaves"), status.alias("status"))


def failback(partitions: DataFrame, node: Column, slot: Column, n_replicas: int) -> DataFrame:
    """A node back in: to the partitions whose slot it is; ACTIVE again when all replicas are there."""
    has = (F.col("master") == node) | F.array_contains("slaves", node)
    slaves = F.when(slot & ~has, F.array_append("slaves", node)).otherwise(F.col("slaves"))
    d = partitions.withColumn("slaves", slaves)
    return d.withColumn("status", F.when(1 + F.size("slaves") >= n_replicas, "ACTIVE").otherwise(F.col("status")))


def candidate(nodes: DataFrame, replicas: DataFrame, in_flight: DataFrame) -> DataFrame:
    """(pid, node): for each partition the least loaded node that neither holds it nor is receiving it.

    ``nodes`` (node, is_fault), ``replicas`` (pid, node), ``in_flight`` (pid, node). Load counts held and
    arriving partitions; at equal load the faulty node back in service comes first, then the smaller name.
    Partitions meet only as many nodes as one of them can exclude, and one more.
    """
    taken = replicas.unionByName(in_flight).distinct()
    load = replicas.unionByName(in_flight).groupBy("node").agg(F.count("*").alias("load"))
    n = nodes.join(load, "node", "left").select("node", "is_fault", F.coalesce("load", F.lit(0)).alias("load"))
    # a partition that excludes m nodes finds its best among the m + 1 least loaded of all
    most = taken.groupBy("pid").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    least = n.orderBy("load", F.col("is_fault").desc(), "node").limit(most + 1)
    every = replicas.select("pid").distinct().join(F.broadcast(least))
    open_ = every.join(taken, ["pid", "node"], "left_anti")
    best = open_.groupBy("pid").agg(F.min_by("node", F.struct("load", (~F.col("is_fault")).alias("f"), "node")).alias("node"))
    return best


def commit_migration(partitions: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply (pid, from_node, to_node): a master's role moves, a slave is replaced or appended; the version goes up."""
    m = moves.select("pid", "from_node", "to_node")
    d = partitions.join(m, "pid", "left")
    moved = F.col("to_node").isNotNull()
    master = F.when(moved & (F.col("master") == F.col("from_node")), F.col("to_node")).otherwise(F.col("master"))
    slaves = F.when(moved & (F.col("master") != F.col("from_node")), F.array_append(F.array_remove("slaves", F.col("from_node")), F.col("to_node"))).otherwise(F.col("slaves"))
    version = F.col("version") + F.when(moved, 1).otherwise(0)
    return d.select("pid", master.alias("master"), slaves.alias("slaves"), version.alias("version"))


def liveness(heartbeats: DataFrame, now_us: int, limit_us: int) -> DataFrame:
    """(node, last_alive, expired): nodes unheard of for longer than the limit."""
    last = heartbeats.groupBy("node").agg(F.max("alive_us").alias("last_alive"))
    return last.withColumn("expired", F.lit(now_us) - F.col("last_alive") > limit_us)


def node_index(replicas: DataFrame) -> DataFrame:
    """(node, tables): the inverted index of (table, node)."""
    return replicas.groupBy("node").agg(F.sort_array(F.collect_set("table")).alias("tables"))


def check_version(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, ok, behind) for claimed (table, epoch, version) against the catalog."""
    a = actual.select("table", F.col("epoch").alias("a_epoch"), F.col("version").alias("a_version"))
    d = expected.join(a, "table", "left")
    same = F.coalesce((F.col("epoch") == F.col("a_epoch")) & (F.col("version") == F.col("a_version")), F.lit(False))
    return d.select("table", same.alias("ok"), F.coalesce(F.col("version") < F.col("a_version"), F.lit(False)).alias("behind"))
