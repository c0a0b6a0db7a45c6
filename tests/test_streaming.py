"""Streams give what the batch form gives."""

import json

from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.session import table
from tessera.streaming import metrics_stream as ms


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_ticks_equal_batch(spark, sf, tmp_path):
    e = table(spark, sf, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = ms.read_folder(spark, str(tmp_path / "in"), e.schema, 1)
    got = run(ms.ticks(s, "ts", ["event_type"], "event_id", "1 hour"), "ticks_out", "complete")
    want = e.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.sum("event_id").alias("total"), F.count("*").alias("num"), F.max("event_id").alias("high"))
    want = want.select("event_type", F.col("w.start").alias("tick"), "total", "num", "high")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 50


def test_stateful_fold(spark, sf, tmp_path):
    e = table(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("v"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ms.read_folder(spark, str(tmp_path / "in"), e.schema)

    def step(state, ev):
        state["n"] += int(ev.v)
        return (state["n"],)

    got = run(ms.stateful_fold(s, "node", ["seq"], lambda: {"n": 0}, step, "node long, seq long, total long", json.dumps, json.loads), "fold_out", "append")
    want = folds.counter(e, "node", "seq", "v").select("node", "seq", (F.col("previous") + F.col("v")).alias("total"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_ordered_sink(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, 1)], "seq long, priority long").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    s = ms.read_folder(spark, str(tmp_path / "in"), "seq long, priority long")
    q = s.writeStream.foreachBatch(ms.ordered_sink("priority", "seq", lambda b: seen.extend(r.seq for r in b.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [2, 3, 1, 4]


def test_server_feed(spark, tmp_path):
    folder, seen = tmp_path / "lists", []
    folder.mkdir()
    (folder / "1").write_text("a:1\nb:2 # off\n")
    q = ms.watch_servers(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(ms.server_feed(lambda d: seen.append(sorted(map(tuple, d.collect()))))).start()
    q.processAllAvailable()
    (folder / "2").write_text("b:2\nc:3 tag\n")
    q.processAllAvailable()
    q.stop()
    assert seen == [[("a:1:", "added"), ("b:2:", "added")], [("a:1:", "removed"), ("c:3:tag", "added")]]
