"""Ordered folds: breakers, limits, state machines, quorum, replicated logs.

Folds that a frame can express are window expressions. The others are pure
functions of (state, event) run over each key's events in order, grouped by key;
a key's events are one server's or one record's, in total order.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranking import running_max_before


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """One output row for each event: ``step(state, event)`` updates the state in place and returns the output after the key and order columns."""
    columns = [p.split()[0] for p in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        for e in pdf.sort_values(order).itertuples(index=False):
            out.append((getattr(e, key), *[getattr(e, c) for c in order], *step(state, e)))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy(key).applyInPandas(run, schema)


class EmaRecorder:
    """One window of a breaker: what errors cost against an exponential average of the latency; every step truncates to an integer.

    Until the window has been filled once, errors are counted instead: one is unhealthy if as many as the percentage
    allows have gone before it. The averages are kept up all the while.
    """

    #: Costs below this are forgotten at the next success.
    LEAST_COST = 500

    def __init__(self, window: int, max_error_percent: int, max_cost_ratio: int = 2, epsilon: float = 0.02) -> None:
        self.window, self.percent, self.ratio, self.epsilon = window, max_error_percent, max_cost_ratio, epsilon
        self.smooth = epsilon ** (1.0 / window)
        self.seen = self.errors = 0
        self.cost = self.latency = 0

    def on_call_end(self, error: bool, latency: int) -> bool:
        """False when the window says broken."""
        if error:
            good = self._charge(min(self.latency * self.ratio, latency) if self.latency else latency)
        else:
            self.latency = int(self.latency * self.smooth + latency * (1 - self.smooth)) if self.latency else latency
            good = self._charge(0)
        if self.seen >= self.window:
            return good
        self.seen += 1
        before = self.errors
        self.errors += error
        return not error or before < self.window * self.percent // 100

    def _charge(self, cost: int) -> bool:
        if cost:
            self.cost += cost
            # without a latency yet there is no allowance
            return self.cost <= int(self.latency * self.window * (self.percent / 100.0) * (1.0 + self.epsilon))
        self.cost = int(self.cost * self.smooth) if self.cost >= self.LEAST_COST else 0
        return True

    def reset(self) -> None:
        """What an isolation leaves: a window that was never full starts anew, a full one keeps its latency."""
        if self.seen < self.window:
            self.seen = self.errors = self.latency = 0
        self.cost = 0


class CircuitBreaker:
    """A long and a short window; broken when either says so. Calls turned away for overload aren't looked at."""

    def __init__(self, long: int = 3000, short: int = 1500, long_percent: int = 5, short_percent: int = 10) -> None:
        self.windows = [EmaRecorder(long, long_percent), EmaRecorder(short, short_percent)]
        self.broken = False
        self.isolated = 0
        self.duration_ms, self.reset_ms = 100, 0

    def on_call_end(self, error: bool, latency: int, overload: bool = False, now_ms: int = 0) -> bool:
        if overload:
            return True
        if self.broken:
            return False
        # the short window isn't told of a call that breaks the long one
        if all(w.on_call_end(error, latency) for w in self.windows):
            return True
        self.broken = True
        self.isolated += 1
        self.duration_ms = isolation_ms(now_ms - self.reset_ms, self.duration_ms)
        return False

    def reset(self, now_ms: int = 0) -> None:
        for w in self.windows:
            w.reset()
        self.broken, self.reset_ms = False, now_ms


def isolation_ms(since_last_ms: int, last_ms: int, least: int = 100, most: int = 30_000) -> int:
    """Isolation doubles if the breaker broke again soon, else starts anew."""
    return min(last_ms * 2, most) if since_last_ms < most else least


def circuit_breaker(calls: DataFrame, **sizes: int) -> DataFrame:
    """(node, seq, healthy) for calls (node, seq, error, latency[, overload])."""
    over = "overload" in calls.columns
    return fold(calls, "node", ["seq"], lambda: CircuitBreaker(**sizes), lambda s, e: (s.on_call_end(bool(e.error), int(e.latency), over and bool(e.overload)),), "node long, seq long, healthy boolean")


class AutoLimit:
    """Concurrency limit from the least latency and the best rate of sample windows (a second or ``most`` samples, at least ``least``).

    Failed calls add their latency to that of the good ones. The allowance above the product of the two shrinks by
    steps while the server is loaded and grows while it isn't. From time to time the limit drops, samples are left out until
    the queue has run dry, and the least latency is measured anew; ``draw`` gives the seconds in between, a
    number in [0, 1) of half the interval.
    """

    MOST_EXPLORE, LEAST_EXPLORE, STEP, REDUCED = 0.3, 0.06, 0.02, 0.9

    def __init__(self, start: int = 40, least: int = 100, most: int = 200, window_us: int = 1_000_000, every_us: int = 100, alpha: float = 0.1, remeasure_us: int = 50_000_000, floor: int = 9, draw: Callable[[], float] = lambda: 0.5) -> None:
        self.limit, self.least, self.most, self.window, self.every, self.alpha = start, least, most, window_us, every_us, alpha
        self.remeasure, self.floor, self.draw = remeasure_us, floor, draw
        self.explore = self.MOST_EXPLORE
        self.min_latency, self.max_qps = -1.0, -1.0
        self.remeasure_at: float | None = None
        self.reset_at = self.last = self.begin = 0
        self.good_calls = 0
        self._clear(0)

    def _clear(self, at_us: int) -> None:
        self.begin, self.good, self.bad, self.good_us, self.bad_us, self.good_calls = at_us, 0, 0, 0, 0, 0

    def _next(self, at_us: int) -> float:
        half = self.remeasure // 2
        return at_us + half + int(self.draw() * half)

    def add(self, at_us: int, error: bool, latency: int, overload: bool = False) -> int:
        if self.remeasure_at is None:
            self.remeasure_at = self._next(at_us)
        if overload:
            return self.limit
        self.good_calls += not error
        if not self.last or at_us - self.last >= self.every:
            self.last = at_us
            self._sample(at_us, error, latency)
        return self.limit

    def _sample(self, at_us: int, error: bool, latency: int) -> None:
        if self.reset_at:
            if self.reset_at > at_us:
                return
            self.min_latency, self.reset_at = -1.0, 0
            self.remeasure_at = self._next(at_us)
            self._clear(at_us)
        self.begin = self.begin or at_us
        if error:
            self.bad, self.bad_us = self.bad + 1, self.bad_us + latency
        else:
            self.good, self.good_us = self.good + 1, self.good_us + latency
        n, over = self.good + self.bad, at_us - self.begin >= self.window
        if n < self.least:
            if over:
                self._clear(at_us)
        elif over or n >= self.most:
            self._set(self._fitted(at_us) if self.good else self.limit // 2)
            self._clear(at_us)

    def _set(self, limit: int) -> None:
        self.limit = max(self.floor, limit)

    def _fitted(self, at_us: int) -> int:
        mean = math.ceil((self.bad_us + self.good_us) / self.good)
        qps = 1e6 * self.good_calls / max(1, at_us - self.begin)
        if self.min_latency <= 0:
            self.min_latency = mean
        elif mean < self.min_latency:
            self.min_latency = int(mean * self.alpha + self.min_latency * (1 - self.alpha))
        slow = self.alpha / 10
        self.max_qps = qps if qps >= self.max_qps else qps * slow + self.max_qps * (1 - slow)
        if self.remeasure_at <= at_us:
            self.reset_at = at_us + 2 * mean
            return math.ceil(self.max_qps * self.min_latency / 1e6 * self.REDUCED)
        idle = mean <= self.min_latency * (1.0 + self.LEAST_EXPLORE) or qps <= self.max_qps / (1.0 + self.LEAST_EXPLORE)
        self.explore = min(self.MOST_EXPLORE, self.explore + self.STEP) if idle else max(self.LEAST_EXPLORE, self.explore - self.STEP)
        return int(self.min_latency * self.max_qps / 1e6 * (1 + self.explore))


def auto_limit(calls: DataFrame, **sizes: int) -> DataFrame:
    return fold(calls, "node", ["at_us", "seq"], lambda: AutoLimit(**sizes), lambda s, e: (s.add(int(e.at_us), bool(e.error), int(e.latency)),), "node long, at_us long, seq long, limit_now long")


class LocalityWeight:
    """Weight of a server: its rate over its latency across a bounded queue of good calls, not under a floor.

    A failed call makes the last one slower, by its own latency times 1.2 or, with no retry left, by the timeout. Calls in flight
    that have waited longer than 1.5 average latencies lower the weight in proportion.
    """

    #: Fixed value: one call a second.
    SCALE = (2**63 - 1) // 72_000_000 // 127
    ERROR, WAIT = 1.2, 1.5

    def __init__(self, queue: int = 128, floor: int = 1000, timeout_us: int = 500_000) -> None:
        self.queue, self.floor, self.timeout = queue, floor, timeout_us
        self.calls: deque[list[int]] = deque()
        self.weight = self.base = floor
        self.latency = 0
        self.flying = self.flying_since = 0

    def begin(self, at_us: int) -> None:
        self.flying, self.flying_since = self.flying + 1, self.flying_since + at_us

    def update(self, at_us: int, error: bool, latency: int, retried: int = 0, max_retry: int = 0) -> int:
        """The weight after a call that ended at ``at_us``."""
        if self.flying:
            self.flying, self.flying_since = self.flying - 1, self.flying_since - (at_us - latency)
        if latency <= 0:
            return self.weight
        if error:
            done, left = (retried, max_retry - retried) if max_retry else (1, 0)
            cost = (left * int(latency * self.ERROR) + done * self.timeout) // (done + left)
            if self.calls:
                self.calls[-1][0] += cost
                self.calls[-1][1] = at_us
            else:
                self.calls.append([max(cost, self.timeout), at_us])
        else:
            if len(self.calls) == self.queue:
                self.calls.popleft()
            self.calls.append([latency + (self.calls[-1][0] if self.calls else 0), at_us])
        (first_sum, first_at), n = self.calls[0], len(self.calls)
        qps = self.SCALE
        if at_us > first_at and n > 1:
            # a rate is known once the queue is full or a second long
            if n == self.queue or at_us >= first_at + 1_000_000:
                qps = max(self.SCALE, (n - 1) * 1_000_000 * self.SCALE // (at_us - first_at))
            self.latency = (self.calls[-1][0] - first_sum) // (n - 1)
        elif n == 1:
            self.latency = self.calls[-1][0]
        else:
            return self.weight
        if self.latency:
            self.base = qps // self.latency
            self._punish(at_us)
        return self.weight

    def _punish(self, at_us: int) -> None:
        weight = self.base
        if self.flying:
            waited, allowed = at_us - self.flying_since // self.flying, int(self.latency * self.WAIT)
            if waited >= allowed and waited > 0:
                weight = weight * allowed // waited
        self.weight = max(self.floor, weight)


def locality_weights(calls: DataFrame) -> DataFrame:
    return fold(calls, "node", ["at_us", "seq"], LocalityWeight, lambda s, e: (s.update(int(e.at_us), bool(e.error), int(e.latency)),), "node long, at_us long, seq long, weight long")


def counter(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """fetch-and-add: each event sees the sum before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.coalesce(F.sum(value).over(w), F.lit(0)))


def exchange(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each event sees the value stored before it; a missing one reads 0."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous", F.coalesce(F.lag(value).over(w), F.lit(0)))


def atomic_map(ops: DataFrame) -> DataFrame:
    """(id, seq, ok, value) for ops (id, seq, op, value, expected) of get, exchange and cas, over a map that reads 0 where unset.

    A fold of each id's operations in order, on the JVM.
    """
    one = F.struct(F.col("seq").cast("long").alias("seq"), "op", F.col("value").cast("long").alias("value"), F.col("expected").cast("long").alias("expected"))
    g = ops.groupBy(F.col("id").cast("long").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    none = F.array().cast("array<struct<seq:bigint,ok:boolean,value:bigint>>")

    def step(acc: Column, e: Column) -> Column:
        old, cas = acc["v"], e["op"] == "cas"
        ok = ~cas | (old == e["expected"])
        new = F.when((e["op"] == "exchange") | (cas & ok), e["value"]).otherwise(old)
        return F.struct(new.alias("v"), F.array_append(acc["out"], F.struct(e["seq"].alias("seq"), ok.alias("ok"), old.alias("value"))).alias("out"))

    done = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("v"), none.alias("out")), step, lambda a: a["out"])
    return g.select("id", F.explode(done).alias("x")).select("id", "x.seq", "x.ok", "x.value")


def memcache(ops: DataFrame) -> DataFrame:
    """(key, seq, status, value) of documented memcache operations in order, keys apart.

    ops: key, seq, op, value (string), number (delta or cas). A set with a cas other than 0 needs the current one. A flush,
    of whatever key, empties all keys for the operations after it; it has no row of its own, and a seq is one operation.
    """
    if ops.where("op = 'flush'").limit(1).count():
        marked = running_max_before(ops.withColumn("_f", F.when(F.col("op") == "flush", F.col("seq"))), "seq", "_f", "flushed")
        ops = marked.where("op <> 'flush'").drop("_f")
    else:
        ops = ops.withColumn("flushed", F.lit(None).cast("long"))

    def step(s: dict, e) -> tuple:
        if e.flushed == e.flushed and e.flushed is not None and s.get("flushed") != e.flushed:
            s.clear()
            s["flushed"] = e.flushed
        has, op = "v" in s, e.op
        if op == "version":
            return "ok", "1"
        if op == "touch":
            return ("ok" if has else "not_found"), None
        if op == "get":
            return ("ok", s["v"]) if has else ("not_found", None)
        if op in ("incr", "decr"):
            if not has or not str(s["v"]).isdigit():
                return ("not_found" if not has else "bad_value"), None
            n = int(s["v"]) + int(e.number) if op == "incr" else max(0, int(s["v"]) - int(e.number))
            s["v"], s["cas"] = str(n % (1 << 64)), s["cas"] + 1
            return "ok", s["v"]
        if op == "delete":
            s.pop("v", None)
            return ("ok" if has else "not_found"), None
        if op == "add" and has or op in ("replace", "append", "prepend") and not has:
            return "not_stored", None
        if op == "set" and int(e.number or 0) != 0 and (not has or s["cas"] != int(e.number)):
            return ("exists" if has else "not_found"), None
        s["v"] = {"append": s.get("v", "") + e.value, "prepend": e.value + s.get("v", "")}.get(op, e.value)
        s["cas"] = s.get("cas", 0) + 1
        return "ok", s["v"]

    return fold(ops, "key", ["seq"], dict, step, "key long, seq long, status string, value string")


def quorum(matches: DataFrame, group: str, index: str) -> DataFrame:
    """(group, committed): the highest index that more than half of the members have.

    Members are counted by index, so a group costs its different indexes and not its members.
    """
    d = matches.groupBy(group, index).agg(F.count("*").alias("_n"))
    higher = Window.partitionBy(group).orderBy(F.col(index).desc())
    every = Window.partitionBy(group)
    d = d.withColumn("_have", F.sum("_n").over(higher)).withColumn("_all", F.sum("_n").over(every))
    return d.where(2 * F.col("_have") > F.col("_all")).groupBy(group).agg(F.max(index).alias("committed"))


def joint_quorum(matches: DataFrame, group: str, index: str, old: str, new: str) -> DataFrame:
    """(group, committed) while members change: what more than half of the old and more than half of the new members have.

    ``old`` and ``new`` are boolean columns; a configuration without members asks for nothing.
    """
    a = quorum(matches.where(old), group, index).withColumnRenamed("committed", "_old")
    b = quorum(matches.where(new), group, index).withColumnRenamed("committed", "_new")
    return a.join(b, group, "full").select(group, F.least("_old", "_new").alias("committed"))


def resolve_log(entries: DataFrame) -> DataFrame:
    """Log entries (log_index, term, ...) after conflicts: the highest term of each index, and nothing after an index whose winner is of a later term than its successor's."""
    top = entries.groupBy("log_index").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "log_index"]), "term").alias("e")).select("log_index", "e.*")
    before = running_max_before(top, "log_index", "term", "_before")
    return before.where(F.col("_before").isNull() | (F.col("term") >= F.col("_before"))).drop("_before")


def truncate_log(entries: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    if first is not None:
        entries = entries.where(F.col("log_index") >= first)
    return entries if last is None else entries.where(F.col("log_index") <= last)


def snapshot_at(ops: DataFrame, key: str, order: str, index: int) -> DataFrame:
    """(key, op, value, ...) of the state after the log up to ``index``: the last operation of each key."""
    fields = [c for c in ops.columns if c != key]
    return ops.where(F.col(order) <= index).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(key, "_r.*")


def replay_from(snapshot: DataFrame, ops: DataFrame, key: str, order: str, index: int) -> DataFrame:
    """The state of the whole log from a snapshot at ``index`` and the operations after it; what the snapshot covers isn't read again."""
    later = ops.where(F.col(order) > index)
    return snapshot_at(snapshot.unionByName(later), key, order, (1 << 63) - 1)


def throttle(rows: DataFrame, key: list[str], cycle: str, order: str, size: str, limit: int, used: str | None = None) -> DataFrame:
    """Granted bytes of requests in a cycle: what the limit leaves after those before; ``used`` says what of it they took, the rest goes back."""
    if used is not None:
        return _throttle_with_returns(rows, key, cycle, order, size, limit, used)
    w = Window.partitionBy(*key, cycle).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return rows.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(size), F.lit(limit) - before)))


def config_diff(old: Column, new: Column) -> tuple[Column, Column]:
    """Members added and removed between two comma-separated configurations."""
    a, b = F.array_distinct(F.split(old, ",")), F.array_distinct(F.split(new, ","))
    return F.array_except(b, a), F.array_except(a, b)


def _throttle_with_returns(rows: DataFrame, key: list[str], cycle: str, order: str, size: str, limit: int, used: str) -> DataFrame:
    """A grant depends on what those before gave back: an ordered fold of the cycle's requests, on the JVM."""
    fields = [c for c in rows.columns if c not in (*key, cycle)]
    g = rows.groupBy(*key, cycle).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))).alias("_rows"))
    none = F.slice(F.transform("_rows", lambda x: F.struct(*[x[c].alias(c) for c in fields], F.lit(0).cast("long").alias("granted"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        grant = F.greatest(F.lit(0).cast("long"), F.least(x[size].cast("long"), acc["left"]))
        out = F.struct(*[x[c].alias(c) for c in fields], grant.alias("granted"))
        return F.struct((acc["left"] - F.least(grant, x[used].cast("long"))).alias("left"), F.array_append(acc["out"], out).alias("out"))

    done = F.aggregate("_rows", F.struct(F.lit(limit).cast("long").alias("left"), none.alias("out")), step, lambda a: a["out"])
    return g.select(*key, cycle, F.explode(done).alias("_x")).select(*key, cycle, "_x.*")
