"""Streaming forms: tick aggregates with watermarks, sinks by batch, liveness and folds with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_folder(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """A folder as a stream, so many files at a time: the bounded window of a sender."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def watch_servers(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of server lists as files of a folder appear; ``server_feed`` turns them into changes."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(path)


def server_feed(consume: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is a whole server list, and what it adds to and takes from the one before is handed on.

    The list last seen is kept as a written table, so nothing but its place is held between batches.
    """
    from tessera.operators.trace import snapshot_diff
    from tessera.session import materialise, release
    from tessera.sources.importers import server_list

    last: list[DataFrame] = []

    def run(batch: DataFrame, _: int) -> None:
        now = materialise(server_list(batch.withColumn("place", F.monotonically_increasing_id())).select(F.concat_ws(":", "host", "port", "tag").alias("server")), "servers")
        before = last[0] if last else now.where("false")
        consume(snapshot_diff(now, before, "server"))
        release(*last)
        last[:] = [now]

    return run


def ticks(stream: DataFrame, ts: str, keys: list[str], value: str, tick: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Sum, count and maximum of each key and tick; rows later than the watermark are dropped, as a passed sampling tick."""
    d = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = d.groupBy(*keys, F.window("_ts", tick).alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("num"), F.max(value).alias("high"))
    return g.select(*keys, F.col("w.start").alias("tick"), "total", "num", "high")


def sliding(stream: DataFrame, ts: str, keys: list[str], value: str, span: str, tick: str = "1 second", late: str = "5 seconds") -> DataFrame:
    d = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = d.groupBy(*keys, F.window("_ts", span, tick).alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("num"))
    return g.select(*keys, F.col("w.end").alias("at"), "total", "num")


def ordered_sink(priority: str, seq: str, consume: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on each batch by priority, then sequence."""

    def run(batch: DataFrame, _: int) -> None:
        consume(batch.orderBy(F.col(priority).desc(), F.col(seq)))

    return run


def routed_sink(path: str, tab: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends metric lines to one folder for each tab, overwriting a batch that runs again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", tab).json(path)

    return run


def stateful_fold(stream: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], out_schema: str, dump: Callable[[Any], str], load: Callable[[str], Any]) -> DataFrame:
    """An ordered fold with state kept between batches; within a batch events go in order of ``order``."""
    columns = [p.split()[0] for p in out_schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = load(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(order)
        out = [(k[0], *[getattr(e, c) for c in order], *step(s, e)) for e in rows.itertuples(index=False)]
        state.update((dump(s),))
        yield pd.DataFrame(out, columns=columns)

    return stream.groupBy(key).applyInPandasWithState(run, out_schema, "state string", "append", GroupStateTimeout.NoTimeout)
