"""A small façade over key-value tables kept as Parquet operation logs."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import super_fast_hash
from tessera.operators import kv

_CATALOG = "seq long, name string, event string, partitions int, replicas int, capacity long"


class KvStore:
    """Tables by name below one folder; every write appends a batch to the table's log, partitioned by pid.

    The catalog is a log as well, kept in the folder: a table's state is its last event, and its version counts its
    events. A created table starts in a folder of its own, named after the event, so rows of one dropped before are never
    seen again. Sequence numbers go on from the highest in the folder, so a store opened again writes after, not before,
    what is there. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, create_table: bool = True, partitions: int = 1, nodes: list[str] | None = None) -> None:
        self.spark, self.root, self.create_table = spark, root.rstrip("/"), create_table
        self.default_partitions, self.nodes = partitions, nodes or []
        self.catalog: dict[str, dict[str, int]] = {}
        self.seq = self._versions = 0
        self._load()

    # the folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _load(self) -> None:
        if not self._exists(f"{self.root}/_catalog"):
            return
        for r in sorted(self.spark.read.schema(_CATALOG).parquet(f"{self.root}/_catalog").collect()):
            self._apply(r.asDict())
        for name in self.catalog:
            if self._exists(self._folder(name)):
                self.seq = max(self.seq, self.spark.read.parquet(self._folder(name)).agg(F.max("seq")).first()[0] or 0)

    def _apply(self, e: dict) -> None:
        self.seq = max(self.seq, e["seq"])
        if e["event"] == "create":
            self.catalog[e["name"]] = {"partitions": e["partitions"], "replicas": e["replicas"], "capacity": e["capacity"], "version": 1, "generation": e["seq"]}
        else:
            self.catalog.pop(e["name"], None)

    def _record(self, name: str, event: str, partitions: int = 0, replicas: int = 0, capacity: int = 0) -> None:
        self.seq += 1
        row = (self.seq, name, event, partitions, replicas, capacity)
        self.spark.createDataFrame([row], _CATALOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_catalog")
        self._apply(dict(zip([p.split()[0] for p in _CATALOG.split(", ")], row, strict=True)))

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}/g{self.catalog[name]['generation']}"

    # definitions

    def create(self, name: str, partitions: int = 1, replicas: int = 2, capacity: int = 0, nodes: int = 1) -> str:
        if name in self.catalog:
            return "exist"
        self._record(name, "create", partitions, max(1, min(replicas, 5, nodes)), capacity)
        return "ok"

    def drop(self, *names: str, versions: dict[str, int] | None = None) -> str:
        """All of the tables or none; with ``versions`` only if they are at these."""
        if any(n not in self.catalog for n in names):
            return "not_found"
        if versions is not None and any(self.catalog[n]["version"] != versions.get(n) for n in names):
            return "version_mismatch"
        for n in names:
            at, fs = self._fs(f"{self.root}/{n}")
            self._record(n, "drop")
            fs.delete(at, True)
        return "ok"

    def tables(self) -> list[str]:
        return sorted(self.catalog)

    def flush(self, name: str) -> str:
        """Nothing is buffered: a batch is written when it is set."""
        return "ok" if name in self.catalog else "not_found"

    def metas(self, names: list[str] | None = None, node: str | None = None) -> DataFrame:
        """(table, pid, replica, node, role) of all tables, of some, or of those partitions that a node holds."""
        found = self.spark.createDataFrame([], "table string, pid long, replica long, node string, role string")
        spread = self.spark.createDataFrame(list(enumerate(self.nodes)) or [(0, "local")], "idx long, node string")
        for name in self.tables() if names is None else [n for n in names if n in self.catalog]:
            info = self.catalog[name]
            p = kv.placement(info["partitions"], info["replicas"], 0, spread)
            found = found.unionByName(p.withColumn("table", F.lit(name)))
        return found if node is None else found.join(found.where(F.col("node") == node).select("table", "pid").distinct(), ["table", "pid"], "left_semi")

    # rows

    def _append(self, name: str, rows: DataFrame) -> str:
        if name not in self.catalog:
            if not self.create_table:
                return "not_found"
            self.create(name, self.default_partitions)
        info = self.catalog[name]
        self.seq += 1
        info["version"] += 1
        pid = F.lit(0).cast("long") if info["partitions"] == 1 else super_fast_hash(F.col("key")) % info["partitions"]
        rows.withColumn("seq", F.lit(self.seq).cast("long")).withColumn("pid", pid).write.mode("append").partitionBy("pid").parquet(self._folder(name))
        return "ok"

    def set(self, name: str, rows: DataFrame, ttl: int | None, now: int) -> str:
        """Upsert (key, value[, ttl]); the last of equal keys in a batch isn't defined, so batches hold a key once."""
        t = F.col("ttl") if ttl is None else F.lit(ttl)
        d = rows.select("key", F.lit("set").alias("op"), "value", kv.expiry(t, F.lit(now)).alias("expired"))
        return self._append(name, d)

    def delete(self, name: str, keys: DataFrame) -> str:
        return self._append(name, keys.select("key", F.lit("del").alias("op"), F.lit("").alias("value"), F.lit(0).cast("long").alias("expired")))

    def table(self, name: str) -> DataFrame:
        """(key, value, expired, pid) of a table; of one without writes, no rows."""
        if not self._exists(self._folder(name)):
            return self.spark.createDataFrame([], "key string, value string, expired long, pid int")
        return kv.state(self.spark.read.parquet(self._folder(name)))

    def get(self, name: str, keys: DataFrame, now: int) -> DataFrame:
        return kv.get(self.table(name), keys, now)

    def list(self, name: str, offset: int, size: int, now: int) -> DataFrame:
        return kv.list_page(self.table(name), offset, size, now)

    def info(self, name: str) -> DataFrame:
        return kv.table_info(self.table(name))

    def compact(self, name: str, now: int) -> tuple[int, int]:
        """Rewrite a table's log as its live rows, in a new folder; (kept, swept)."""
        live, counts = kv.compact(self.table(name), now)
        kept = counts.first()
        info, old = dict(self.catalog[name]), self._folder(name)
        self._record(name, "create", info["partitions"], info["replicas"], info["capacity"])
        self.catalog[name]["version"] = info["version"] + 1
        live.withColumn("op", F.lit("set")).withColumn("seq", F.lit(self.seq).cast("long")).write.partitionBy("pid").parquet(self._folder(name))
        at, fs = self._fs(old)
        fs.delete(at, True)
        return kept["kept"], kept["swept"]

    def run(self, line: str, now: int) -> str:
        """One command line: info, create_table, table_info, set, get, del, drop, list."""
        verb, *args = shlex.split(line) or [""]
        one = lambda kind, *v: self.spark.createDataFrame([v], kind)
        if verb == "info" and not args:
            return "\n".join(f"{n} {self.catalog[n]['partitions']} {self.catalog[n]['replicas']}" for n in self.tables())
        if verb == "create_table" and 1 <= len(args) <= 3:
            return self.create(args[0], *map(int, args[1:]), nodes=max(1, len(self.nodes)))
        if verb == "drop" and args:
            return self.drop(*args)
        if verb == "set" and len(args) in (3, 4):
            return self.set(args[0], one("key string, value string", args[1], args[2]), int(args[3]) if len(args) == 4 else -1, now)
        known = bool(args) and args[0] in self.catalog
        if verb in ("table_info", "get", "del", "list") and args and not known:
            return "not_found"
        if verb == "table_info" and len(args) == 1:
            return "\n".join(f"{r.pid} {r['size']} {r.start_offset}" for r in self.info(args[0]).orderBy("pid").collect())
        if verb == "get" and len(args) == 2:
            return self.get(args[0], one("key string", args[1]), now).first()["value"] or "not exist"
        if verb == "del" and len(args) == 2:
            return self.delete(args[0], one("key string", args[1]))
        if verb == "list" and len(args) == 3:
            return "\n".join(f"{r.key} {r['value']}" for r in self.list(args[0], int(args[1]), int(args[2]), now).orderBy("place").collect())
        return "unknown command"


def replicated(writes: DataFrame, acks: DataFrame) -> DataFrame:
    """(write, ok): a write of (write, replicas) holds once every replica has said so; acks are (write, node, ok)."""
    a = acks.where("ok").groupBy("write").agg(F.count_distinct("node").alias("_n"))
    return writes.join(a, "write", "left").select("write", (F.coalesce("_n", F.lit(0)) >= F.col("replicas")).alias("ok"))


def copy_batches(rows: DataFrame, pid: Column, size: int = 10_000) -> DataFrame:
    """(batch, ...) of the raw rows of a partition, expired ones too, ``size`` at a time in order of the key's hash: what a move of it sends.

    Rows are numbered within ranges of the hash, so no task holds the whole partition.
    """
    from tessera.operators.ranking import ranked

    d = rows.where(F.col("pid") == pid).withColumn("_h", F.xxhash64("key"))
    return ranked(d, "_h", "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place", "_h")
