"""Assignment of requests to servers: rings, round robins, weights, partitions, scatter and gather."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIRTUAL_NODES = 100


def ring(servers: DataFrame, name: str, point: Callable[[Column], Column], n: int = VIRTUAL_NODES) -> DataFrame:
    """(point, server): ``n`` virtual nodes ``name-i`` of each server; of equal points the smallest name stays."""
    d = servers.select(F.col(name).alias("server"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    d = d.select(point(F.concat_ws("-", F.col("server").cast("string"), F.col("i").cast("string"))).alias("point"), "server")
    return d.groupBy("point").agg(F.min("server").alias("server"))


def ketama_ring(servers: DataFrame, name: str, word: Callable[[Column, int], Column], n: int = VIRTUAL_NODES // 4) -> DataFrame:
    """Four points from each digest."""
    d = servers.select(F.col(name).alias("server"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    text = F.concat_ws("-", F.col("server").cast("string"), F.col("i").cast("string"))
    d = d.select("server", F.explode(F.array(*[word(text, k) for k in range(4)])).alias("point"))
    return d.groupBy("point").agg(F.min("server").alias("server"))


def lookup(requests: DataFrame, code: str, points: DataFrame, buckets: int = 512, space: int = 1 << 32) -> DataFrame:
    """``requests`` with the server of the first point at or after their code, around the ring; codes lie in [0, space).

    A forward as-of join by union and frame. The code space is cut into ranges, each a partition of its
    own that starts from the first point of the ranges after it, so no task sees the whole ring of requests.
    """
    buckets = max(1, min(buckets, space))
    width = -(-space // buckets)
    first = points.groupBy(F.floor(F.col("point") / width).cast("int").alias("b")).agg(F.min("point").alias("p"), F.min_by("server", "point").alias("s"))
    spine = points.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    after = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    firsts = spine.join(first, "b", "left").select("b", F.coalesce(F.first("s", ignorenulls=True).over(after), F.min_by("s", "p").over(every)).alias("next_server"))
    r = requests.withColumn("_b", F.floor(F.col(code) / width).cast("int")).withColumn("_kind", F.lit(1)).withColumn("_s", F.lit(None).cast(dict(points.dtypes)["server"]))
    p = points.select(F.col("point").alias(code), F.floor(F.col("point") / width).cast("int").alias("_b"), F.lit(0).alias("_kind"), F.col("server").alias("_s"))
    u = r.unionByName(p, allowMissingColumns=True)
    # from the end backwards: a growing frame is linear, a shrinking one isn't
    ahead = Window.partitionBy("_b").orderBy(F.col(code).desc(), F.col("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = u.withColumn("_f", F.last("_s", ignorenulls=True).over(ahead)).where("_kind = 1")
    return found.join(F.broadcast(firsts), F.col("_b") == F.col("b")).withColumn("server", F.coalesce("_f", "next_server")).drop("_b", "_kind", "_s", "_f", "b", "next_server")


def round_robin(requests: DataFrame, seq: str, n_servers: int, offset: int = 0, stride: int = 1) -> DataFrame:
    """Server (offset + stride * (i + 1)) mod n of request i; the stride is moved up until it shares no divisor with n."""
    while gcd(stride, n_servers) != 1:
        stride += 1
    return requests.withColumn("server", F.pmod(F.lit(offset) + F.lit(stride) * (F.col(seq) + 1), F.lit(n_servers)))


def valid_weight(tag: Column) -> Column:
    """The weight of a tag: an unsigned integer above 0, else null."""
    w = F.when(tag.rlike("^[0-9]+$"), tag.try_cast("long"))
    return F.when(w > 0, w)


def weighted_round_robin(requests: DataFrame, seq: str, servers: DataFrame) -> DataFrame:
    """Each full cycle of all weights gives every server exactly its weight. ``servers`` is (server, weight).

    A server owns the slots of the cycle up to its cumulative weight; the cycle is walked with a coprime stride.
    """
    total = servers.agg(F.sum("weight")).first()[0]
    stride = max(1, int(total * 0.618))
    while gcd(stride, total) != 1:
        stride += 1
    r = requests.withColumn("slot", F.pmod(F.col(seq) * F.lit(stride), F.lit(total)))
    return lookup(r, "slot", _slots(servers), space=total)


def _slots(servers: DataFrame) -> DataFrame:
    """(point, server): the last slot of each server when they lie side by side, as many slots each as its weight; the window is over one row a server."""
    upto = F.sum("weight").over(Window.orderBy("server").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return servers.where("weight > 0").select((upto - 1).cast("long").alias("point"), "server")


def weighted_pick(requests: DataFrame, uniform: Column, servers: DataFrame) -> DataFrame:
    """A server in proportion to its weight (a whole number), by a uniform number in [0, 1) of each request: a look-up among slots, not a range join."""
    total = servers.agg(F.sum("weight")).first()[0]
    r = requests.withColumn("_slot", F.floor(uniform * F.lit(float(total))).cast("long"))
    return lookup(r, "_slot", _slots(servers), space=total).drop("_slot")


def partition_tag(tag: Column) -> Column:
    """(index, total) of a tag ``N/M``; null if it isn't one."""
    n, m = F.regexp_extract(tag, r"^([0-9]+)/([0-9]+)$", 1), F.regexp_extract(tag, r"^([0-9]+)/([0-9]+)$", 2)
    return F.when(m != "", F.struct(n.try_cast("int").alias("index"), m.try_cast("int").alias("total")))


def scatter_gather(calls: DataFrame, request: str, failed: Column, value: Column, fail_limit: int | None = None) -> DataFrame:
    """Sub-calls merged by request: (request, value, failures, ok); it fails from ``fail_limit`` failures on, by default all."""
    d = calls.groupBy(request).agg(F.sum(F.when(~failed, value)).alias("value"), F.sum(failed.cast("int")).cast("long").alias("failures"), F.count("*").alias("n"))
    limit = F.col("n") if fail_limit is None else F.least(F.lit(fail_limit), F.col("n"))
    return d.select(request, F.coalesce("value", F.lit(0)).alias("value"), "failures", (F.col("failures") < limit).alias("ok"))


def reject_rate(usable: Column, min_working: Column) -> Column:
    """Share of requests turned away while a cluster recovers."""
    return F.greatest(F.lit(0.0), 1.0 - usable / min_working)


def keep_servers(servers: DataFrame, accept: Column) -> DataFrame:
    """The servers a watcher's filter accepts."""
    return servers.where(accept)


def feed(new: DataFrame, old: DataFrame, key: str, watchers: dict[str, Column]) -> DataFrame:
    """(watcher, key, change) for each watcher what was added and removed among the servers its filter accepts."""
    from tessera.operators.trace import snapshot_diff

    out = None
    for name, accept in watchers.items():
        d = snapshot_diff(keep_servers(new, accept), keep_servers(old, accept), key).select(F.lit(name).alias("watcher"), key, "change")
        out = d if out is None else out.unionByName(d)
    return out


def sub_calls(calls: DataFrame, request: str, action: Column, failed: Column, value: Column, fail_limit: int | None = None) -> DataFrame:
    """``scatter_gather`` of mapped sub-calls: those with action ``skip`` aren't made, one with ``bad`` fails its request."""
    d = calls.withColumn("_a", action)
    bad = d.groupBy(request).agg(F.max((F.col("_a") == "bad").cast("int")).alias("_bad"), F.count(F.when(F.col("_a") != "skip", 1)).alias("_n"))
    got = scatter_gather(d.where("_a <> 'skip'"), request, failed, value, fail_limit)
    d = bad.join(got, request, "left")
    return d.select(request, F.when(F.col("_bad") == 0, F.coalesce("value", F.lit(0))).otherwise(F.lit(0)).alias("value"), (F.coalesce("ok", F.lit(False)) & (F.col("_bad") == 0)).alias("ok"))


def randomized(requests: DataFrame, draw: Column, stride: int, alive: list[bool]) -> DataFrame:
    """``requests`` with the first server alive from a drawn start on, in steps that share no divisor with their number; null if none is."""
    n = len(alive)
    while gcd(stride, n) != 1:
        stride += 1
    up = F.array(*[F.lit(x) for x in alive])
    walk = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(draw * n) + i * stride, F.lit(n)).cast("int"))
    return requests.withColumn("server", F.get(F.filter(walk, lambda s: F.get(up, s)), 0))


def dynamic_partitions(requests: DataFrame, uniform: Column, servers: DataFrame) -> DataFrame:
    """``requests`` with the partitioning (of so many parts) that serves each, by the servers that each has; one that lacks a part takes none; null if all do.

    ``servers`` is (server, tag) with tags ``N/M``. Each request then goes to one server of every part.
    """
    p = servers.select(partition_tag(F.col("tag")).alias("p")).where("p.index < p.total").groupBy(F.col("p.total").alias("total")).agg(F.count_distinct("p.index").alias("parts"), F.count("*").alias("weight"))
    whole = p.where("parts = total").select(F.col("total").alias("server"), "weight")
    if whole.limit(1).count() == 0:
        return requests.withColumn("parts", F.lit(None).cast("int"))
    return weighted_pick(requests, uniform, whole).withColumnRenamed("server", "parts")


def retried(attempts: DataFrame, request: str, order: str, failed: Column, retriable: Column, max_retry: int) -> DataFrame:
    """(request, attempt, ok): which of a request's attempts in order its answer is: the first that succeeds or mustn't be tried again, or the last allowed.

    The attempts are those of one request, at most ``max_retry`` + 1 are looked at.
    """
    w = Window.partitionBy(request).orderBy(order)
    d = attempts.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") <= max_retry)
    last = F.max(F.col("_i")).over(Window.partitionBy(request))
    d = d.withColumn("_f", failed).withColumn("_end", ~F.col("_f") | ~retriable | (F.col("_i") == last))
    best = d.where("_end").groupBy(request).agg(F.min_by(F.struct("_i", "_f"), "_i").alias("r"))
    return best.select(request, F.col("r._i").cast("int").alias("attempt"), (~F.col("r._f")).alias("ok"))


def backup(first_us: Column, second_us: Column, after_us: int) -> Column:
    """(us, backed_up): when a call with a backup is over, a second one being sent if the first takes longer than ``after_us``."""
    sent = first_us > after_us
    return F.struct(F.when(sent, F.least(first_us, second_us + after_us)).otherwise(first_us).alias("us"), (sent & (second_us + after_us < first_us)).alias("backed_up"))


def constant_limit(requests: DataFrame, key: str, begin: str, end: str, limit: int) -> DataFrame:
    """``requests`` (sorted in time by ``begin``) with how many of their key are under way, themselves included, and whether that is within the limit.

    Starts count up and ends count down along one frame for each key; an end at the time of a start comes first.
    """
    d = requests.withColumn("_id", F.struct(begin, end, *[c for c in requests.columns if c not in (key, begin, end)]))
    ends = d.select(key, F.col(end).alias("_at"), F.lit(-1).alias("_step"), F.lit(None).cast(d.schema["_id"].dataType).alias("_id"))
    u = d.select(key, F.col(begin).alias("_at"), F.lit(1).alias("_step"), "_id").unionByName(ends)
    w = Window.partitionBy(key).orderBy("_at", "_step", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = u.withColumn("under_way", F.sum("_step").over(w)).where("_step = 1")
    return found.select(key, "_id.*", F.col("under_way").cast("long").alias("under_way"), (F.col("under_way") <= limit).alias("admitted"))


def selective(requests: DataFrame, seq: str, channels: int, failed: Callable[[Column], Column], max_retry: int, stride: int = 1) -> DataFrame:
    """``requests`` with the channel that answers each: the one whose turn it is, or on failure the next, ``max_retry`` times at most; null if all failed."""
    while gcd(stride, channels) != 1:
        stride += 1
    tries = F.transform(F.sequence(F.lit(0), F.lit(min(max_retry, channels - 1))), lambda k: F.pmod((F.col(seq) + k) * stride, F.lit(channels)).cast("int"))
    return requests.withColumn("channel", F.get(F.filter(tries, lambda c: ~failed(c)), 0))
