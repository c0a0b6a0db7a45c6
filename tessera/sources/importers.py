"""Line importers, server lists, synthetic tables, dumps and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranking import ranked


def pair(line: Column, sep: str) -> tuple[Column, Column, Column]:
    """(key, value, valid) of the first two fields, trimmed."""
    f = F.split(line, sep, -1)
    return F.trim(F.get(f, 0)), F.trim(F.get(f, 1)), F.size(f) >= 2


def import_pairs(lines: DataFrame, sep: str) -> DataFrame:
    """Two-column lines (tab or comma) to (key, value); shorter ones drop out."""
    k, v, ok = pair(F.col("value"), sep)
    return lines.where(ok).select(k.alias("key"), v.alias("value"))


def import_nested(lines: DataFrame) -> DataFrame:
    """``_ TAB key TAB a|b|...`` to (key, "a,b")."""
    f = F.split("value", "\t", -1)
    aux = F.split(F.get(f, 2), r"\|", -1)
    return lines.where((F.size(f) >= 3) & (F.size(aux) >= 2)).select(F.get(f, 1).alias("key"), F.concat_ws(",", F.get(aux, 0), F.get(aux, 1)).alias("value"))


def import_routed(lines: DataFrame) -> DataFrame:
    """``table,key,base64(value)`` to (table, key, value); write with partitionBy("table")."""
    f = F.split("value", ",", -1)
    return lines.where(F.size(f) >= 3).select(F.get(f, 0).alias("table"), F.get(f, 1).alias("key"), F.decode(F.unbase64(F.get(f, 2)), "UTF-8").alias("value"))


def import_ampersand(lines: DataFrame, skip: int = 0) -> DataFrame:
    """``key&value`` after ``skip`` fields; rows with an empty key or value drop out."""
    f = F.split("value", "&", -1)
    d = lines.where(F.size(f) >= 2 + skip).select(F.get(f, skip).alias("key"), F.get(f, skip + 1).alias("value"))
    return d.where("key <> '' AND value <> ''")


def read_slice(spark: SparkSession, path: str, offset: int, size: int) -> DataFrame:
    """Pairs of the CSV lines [offset, offset + size) of a file, in order.

    Lines get ids that grow along the file; their split's number and their place in it. Lines are counted by split, so
    the slice's splits are known and nothing is sorted but the slice.
    """
    split = F.shiftright(F.col("at"), 33)
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("split", split)
    # one row for each split
    before = F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    counts = lines.groupBy("split").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    counts = counts.where((F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset)).select(F.col("split").alias("s"), "before")
    place = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")
    part = lines.join(counts, F.col("split") == F.col("s")).withColumn("place", place).where((F.col("place") >= offset) & (F.col("place") < offset + size))
    return import_pairs(part.orderBy("place"), ",")


def save_pairs(rows: DataFrame, path: str) -> None:
    """Pairs as CSV lines ``key,value``, as ``read_slice`` takes them; keys and values hold no comma or line break."""
    rows.select(F.concat_ws(",", "key", "value").alias("value")).write.text(path)


def load_live(spark: SparkSession, path: str, now: int) -> DataFrame:
    """A whole table of (key, value, expired) without the rows that have expired."""
    return spark.read.parquet(path).where((F.col("expired") == 0) | (F.col("expired") > now))


def synthetic(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(key, value) of random bytes in base64, the same for the same seed."""
    random = lambda s: F.base64(F.unhex(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(f"{seed}-{s}")))))
    return spark.range(n).select(random(0).alias("key"), random(1).alias("value"))


def server_list(lines: DataFrame) -> DataFrame:
    """(place, host, port, tag) of lines ``host:port [tag]``; # starts a comment, the first of equal servers stays.

    ``lines`` is (place, value).
    """
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    p = r"^([^\s:]+):([0-9]+)(?:\s+(\S+))?$"
    d = lines.select("place", F.regexp_extract(text, p, 1).alias("host"), F.regexp_extract(text, p, 2).try_cast("int").alias("port"), F.regexp_extract(text, p, 3).alias("tag")).where("host <> '' AND port <= 65535")
    return d.groupBy("host", "port", "tag").agg(F.min("place").alias("place")).select("place", "host", "port", "tag")


def inline_servers(text: Column) -> Column:
    """host:port pairs of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def consul(json: Column) -> Column:
    """(host, port, tag) entries of a service catalog's JSON; the first tag counts."""
    kind = "array<struct<Service:struct<Address:string,Port:int,Tags:array<string>>>>"
    return F.transform(F.from_json(json, kind), lambda s: F.struct(s["Service"]["Address"].alias("host"), s["Service"]["Port"].alias("port"), F.get(s["Service"]["Tags"], 0).alias("tag")))


def dump_requests(rows: DataFrame, path: str, fraction: float, seed: int, per_file: int = 1000, files: int | None = None, order: str | None = None) -> None:
    """A sample of requests as JSON lines, so many to a file; with a bound of files the newest by ``order`` stay."""
    d = rows.sample(fraction=fraction, seed=seed)
    if files is not None:
        # at most files * per_file rows, a bounded top-n
        d = d.orderBy(F.col(order).desc()).limit(files * per_file)
    d.write.option("maxRecordsPerFile", per_file).mode("overwrite").json(path)


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests of a dump's files with the file each is from; lines that are none come back with ``bad`` set."""
    d = spark.read.schema(schema + ", bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    return d.withColumn("file", F.input_file_name())


def load_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(request, ok) of JSON lines in column ``value``; blank lines drop out."""
    d = lines.where(F.trim("value") != "").select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return d.select(F.col("r").dropFields("_bad").alias("request"), F.col("r._bad").isNull().alias("ok"))


def save_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder whose name fits a glob; their contents aren't read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def save_snapshot(state: DataFrame, path: str, index: int) -> None:
    """The state after log entry ``index``, in a folder of its own."""
    state.write.mode("overwrite").parquet(f"{path}/index={index}")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The latest snapshot below a path, and the log entry it was taken after."""
    d = spark.read.parquet(path)
    last = d.agg(F.max("index")).first()[0]
    return d.where(F.col("index") == last).drop("index"), last


def read_blocks(writes: DataFrame, block: str, order: str, offset: int, size: int) -> DataFrame:
    """(block, data): the bytes [offset, offset + size) of each block after writes (block, order, at, data); what wasn't written reads 0.

    Only bytes of the range are laid out, ``size`` of each block at most.
    """
    end = F.col("at") + F.octet_length("data")
    d = writes.where((F.col("at") < offset + size) & (end > offset))
    places = F.sequence(F.greatest(F.col("at"), F.lit(offset).cast("long")), F.least(end, F.lit(offset + size).cast("long")) - 1)
    d = d.select(block, order, "at", "data", F.explode(places).alias("place"))
    d = d.groupBy(block, "place").agg(F.max_by(F.hex(F.substring(F.col("data"), (F.col("place") - F.col("at") + 1).cast("int"), F.lit(1))), order).alias("x"))
    known = d.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(offset).cast("long"), F.lit(offset + size - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit("00")))
    return known.select(block, F.unhex(F.array_join(whole, "")).alias("data"))


def replay(rows: DataFrame, order: str, times: int, qps: float) -> DataFrame:
    """Every request ``times`` times, with the second at which a throttle lets it go; rounds follow each other."""
    n = rows.count()
    d = ranked(rows, order, "_place").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return d.withColumn("send_s", F.floor((F.col("round") * F.lit(n) + F.col("_place")) / qps).cast("long")).drop("_place")
