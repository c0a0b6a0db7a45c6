"""Learning, simulation, folds, codecs and streaming over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.timeops import micros
from tessera.operators import folds, ml, sim
from tessera.plans import sql_parts
from tessera.session import table
from tessera.sources import codecs, recordio


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("features"))


def _whole_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _first(v):
    """Model at the start: the four rows at equal distances in order of id."""
    return ml.KMeans(4, centroids=ml.uniform_init(v, 4, v.count()))


def kmeans_assign(spark, d):
    v = _whole_vectors(spark, d)
    return _first(v).assign(v).select("id", F.col("label").cast("int").alias("label"), F.round("dist", 6).alias("dist"))


def kmeans_step(spark, d):
    v = _whole_vectors(spark, d)
    n = _first(v).assign(v).select(F.col("label").cast("int").alias("label"), F.posexplode("features").alias("dim", "x"))
    return n.groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


def kmeans_train(spark, d):
    v = _whole_vectors(spark, d)
    return ml.KMeans(4).fit(v).assign(v).select("id", "label", "dist")


def _model(spark, d):
    v = _vectors(spark, d)
    km = _first(v)
    return v, ml.Gmm(4, priors=[0.25] * 4, means=km.centroids, variances=[[0.02] * 3] * 4, floors=[1e-10] * 3)


def gmm_estep(spark, d):
    v, g = _model(spark, d)
    p = g.density(F.col("features"))
    return v.select("id", F.round(p, 6).alias("density"), F.round(F.lit(0.25) * g.component(F.col("features"), 0) / p, 6).alias("share"))


def gmm_train(spark, d):
    g = ml.Gmm(4).fit(_vectors(spark, d))
    return _vectors(spark, d).select("id", g.density(F.col("features")).alias("density"))


def _sequences(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("seq_id"), "ts", "event_id", F.array(F.col("value")).alias("o"))
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "o")))
    return e.groupBy("seq_id").agg(F.transform(ordered, lambda x: x["o"]).alias("obs"))


def hmm_decode(spark, d):
    g = lambda m: ml.Gmm(1, [1.0], [[m]], [[100.0]], [1e-10])
    h = ml.Hmm(3, 1, [0.5, 0.25, 0.25], [[0.5, 0.25, 0.2, 0.05], [0.2, 0.5, 0.25, 0.05], [0.25, 0.2, 0.5, 0.05]], [g(10.0), g(30.0), g(60.0)])
    return h.decode(_sequences(spark, d)).select("seq_id", "pos", "state", F.round("score", 6).alias("score"))


def hmm_train(spark, d):
    h = ml.Hmm(3, 1).fit(_sequences(spark, d))
    return h.decode(_sequences(spark, d))


def life_step(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1")
    cells = li.select((F.col("l_orderkey") * 7 % 256).cast("int").alias("x"), (F.col("l_partkey") % 192).cast("int").alias("y")).distinct()
    return sim.life_step(cells, 256, 192).select("x", "y")


def balance(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("x"), F.col("o_custkey").alias("y"))
    sx, sy = sim.grow("sum", F.col("x"), F.col("y"), F.lit(100))
    px, py = sim.grow("prod", F.col("x"), F.col("y"), F.lit(4), integral=True)
    return r.select("o_orderkey", sx.alias("sum_x"), sy.alias("sum_y"), sim.connection("sum", sx, sy).alias("link"), px.alias("prod_x"), py.alias("prod_y"))


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), micros("ts").alias("at_us"), (F.col("event_type") == "error").alias("error"), F.floor(F.col("value") * 1000).cast("long").alias("latency"))


def circuit_breaker(spark, d):
    return folds.circuit_breaker(_calls(spark, d), long=100, short=50, long_percent=5, short_percent=10)


def auto_limit(spark, d):
    return folds.auto_limit(_calls(spark, d), least=10, most=20, window_us=86_400_000_000)


def lalb(spark, d):
    return folds.locality_weights(_calls(spark, d))


def sm_counter(spark, d):
    c = _calls(spark, d)
    return folds.counter(c, "node", "seq", "latency").select("node", "seq", F.col("previous").cast("long").alias("previous"))


def sm_exchange(spark, d):
    return folds.exchange(_calls(spark, d), "node", "seq", "latency").select("node", "seq", "previous")


def sm_cas(spark, d):
    e = table(spark, d, "events")
    v = F.floor("value").cast("long") % 3
    ops = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "exchange").when(F.col("event_type") == "view", "get").otherwise("cas").alias("op"), v.alias("value"), (v + 1).alias("expected"))
    return folds.atomic_map(ops)


def memcache(spark, d):
    e = table(spark, d, "events")
    names = F.array(*[F.lit(x) for x in ("set", "get", "incr", "append", "add", "delete", "replace", "decr")])
    ops = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get(names, (F.col("event_id") * 7 % 8).cast("int")).alias("op"), F.floor("value").cast("long").cast("string").alias("value"), F.lit(0).cast("long").alias("number"))
    return folds.memcache(ops)


def quorum(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 11).alias("grp"), "l_suppkey").agg(F.sum("l_linenumber").alias("at"))
    return folds.quorum(m, "grp", "at")


def log_conflicts(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 997).alias("log_index"), F.col("user_id").alias("term"))
    return folds.resolve_log(e.distinct())


def log_range(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("log_index"), "event_type")
    return folds.truncate_log(e, 100, 199)


def snapshot_throttle(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber"), "l_orderkey", "l_partkey", "l_extendedprice", F.floor("l_quantity").cast("long").alias("bytes"))
    t = folds.throttle(li.withColumn("o", F.struct("l_orderkey", "l_partkey", "l_extendedprice")), ["l_suppkey"], "l_linenumber", "o", "bytes", 500)
    return t.select("l_suppkey", "l_linenumber", "l_orderkey", F.col("granted").cast("long").alias("granted"))


def config_diff(spark, d):
    a = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")))).cast("array<string>"), ",").alias("old"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey")))).cast("array<string>"), ",").alias("new"))
    plus, minus = folds.config_diff(F.col("old"), F.col("new"))
    return a.where("old <> '' AND new <> ''").select("s_nationkey", F.size(plus).cast("long").alias("n_added"), F.size(minus).cast("long").alias("n_removed"))


def recordio_roundtrip(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))

    def run(batches):
        for b in batches:
            out = []
            for i, p in zip(b["doc_id"], b["payload"], strict=True):
                frame = recordio.encode(p, {"id": str(i).encode()})
                m, x = next(recordio.decode(b"junk" + frame))
                out.append((int(m["id"]), len(frame), x == p))
            yield pd.DataFrame(out, columns=["doc_id", "n_frame", "same"])

    return t.where("payload IS NOT NULL").mapInPandas(run, "doc_id long, n_frame long, same boolean")


def mcpack_roundtrip(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for b in batches:
            out = []
            for i, ts in zip(b["conv_id"], b["turns"], strict=True):
                v = {"id": int(i), "turns": [{"turn": int(t["turn"]), "role": t["role"], "text": t["text"]} for t in ts], "xs": [1.5, 2.5], "none": None}
                raw = codecs.pack(v)
                out.append((i, len(raw), codecs.unpack(raw) == v))
            yield pd.DataFrame(out, columns=["conv_id", "n_bytes", "same"])

    return c.mapInPandas(run, "conv_id long, n_bytes long, same boolean")


def compress_roundtrip(spark, d):
    t = table(spark, d, "documents")
    kinds = ("zlib", "gzip", "snappy")
    c = t.select("doc_id", "text", *[codecs.compress(F.col("text"), k).alias(k) for k in kinds])
    return c.select("doc_id", *[(F.decode(codecs.decompress(F.col(k), k), "UTF-8") == F.col("text")).alias(f"{k}_same") for k in kinds])


QUERIES = {
    "kmeans_assign": kmeans_assign,
    "kmeans_step": kmeans_step,
    "kmeans_train": kmeans_train,
    "gmm_estep": gmm_estep,
    "gmm_train": gmm_train,
    "hmm_decode": hmm_decode,
    "hmm_train": hmm_train,
    "life_step": life_step,
    "balance_grow": balance,
    "circuit_breaker": circuit_breaker,
    "auto_limit": auto_limit,
    "lalb_weight": lalb,
    "sm_counter": sm_counter,
    "sm_exchange": sm_exchange,
    "sm_cas": sm_cas,
    "memcache_fold": memcache,
    "quorum_commit": quorum,
    "log_conflicts": log_conflicts,
    "log_range": log_range,
    "snapshot_throttle": snapshot_throttle,
    "config_diff": config_diff,
    "recordio_roundtrip": recordio_roundtrip,
    "mcpack_roundtrip": mcpack_roundtrip,
    "compress_roundtrip": compress_roundtrip,
}
_K = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM v), k AS (SELECT e AS ke, CAST(i AS INTEGER) AS label FROM o, (SELECT unnest(range(4)) AS i) WHERE rn = floor(i * n / 4)), x AS (SELECT id, e, label, list_distance(e, ke) AS dist FROM v, k), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, label) AS r FROM x) WHERE r = 1)"
_V = "v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM v), k AS (SELECT a AS ka, b AS kb, c AS kc, CAST(i AS INTEGER) AS label FROM o, (SELECT unnest(range(4)) AS i) WHERE rn = floor(i * n / 4)), x AS (SELECT id, a, b, c, label, sqrt((a-ka)*(a-ka) + (b-kb)*(b-kb) + (c-kc)*(c-kc)) AS dist FROM v, k), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, label) AS r FROM x) WHERE r = 1)"
_P = "pow(1 / sqrt(2 * 3.14159 * 0.02), 3) * exp(-((a-ka)*(a-ka) + (b-kb)*(b-kb) + (c-kc)*(c-kc)) / 0.04)"
_CALLS = "(SELECT user_id AS node, event_id AS seq, event_type = 'error' AS error, CAST(floor(value * 1000) AS BIGINT) AS latency FROM events)"


def _breaker() -> str:
    (s1, l1, t1), (s2, l2, t2) = sql_parts.breaker_window("a", 100, 5), sql_parts.breaker_window("b", 50, 10)
    return sql_parts.in_order(_CALLS, "node", "seq", s1 | s2 | {"broken": "false"}, l1 | l2, t1 | t2 | {"broken": "broken OR NOT a_g OR NOT b_g"}, "_key AS node, _at AS seq, NOT broken AS healthy")


def _cas() -> str:
    ops = "(SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'exchange' WHEN 'view' THEN 'get' ELSE 'cas' END AS op, CAST(floor(value) AS BIGINT) % 3 AS value, CAST(floor(value) AS BIGINT) % 3 + 1 AS expected FROM events)"
    start = {"v": "CAST(0 AS BIGINT)", "ok": "true", "old": "CAST(0 AS BIGINT)"}
    step = {"v": "CASE WHEN op = 'exchange' OR op = 'cas' AND v = expected THEN value ELSE v END", "ok": "op <> 'cas' OR v = expected", "old": "v"}
    return sql_parts.in_order(ops, "id", "seq", start, {}, step, "_key AS id, _at AS seq, ok, old AS value")


def _memcache() -> str:
    ops = "(SELECT user_id AS key, event_id AS seq, ['set', 'get', 'incr', 'append', 'add', 'delete', 'replace', 'decr'][event_id * 7 % 8 + 1] AS op, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM events)"
    lets = {
        "digits": "has AND regexp_full_match(v, '[0-9]+')",
        "said": "CASE WHEN op IN ('add') AND has OR op IN ('replace', 'append') AND NOT has THEN 'not_stored' WHEN op IN ('get', 'incr', 'decr', 'delete') AND NOT has THEN 'not_found' WHEN op IN ('incr', 'decr') AND NOT digits THEN 'bad_value' ELSE 'ok' END",
        "new": "CASE WHEN said <> 'ok' OR op IN ('get', 'delete') THEN v WHEN op IN ('incr', 'decr') THEN CAST(CAST(v AS HUGEINT) % 18446744073709551616 AS VARCHAR) WHEN op = 'append' THEN v || value ELSE value END",
    }
    step = {"has": "CASE WHEN op = 'delete' THEN false ELSE has OR said = 'ok' END", "v": "new", "status": "said", "shown": "CASE WHEN said = 'ok' AND op <> 'delete' THEN new END"}
    return sql_parts.in_order(ops, "key", "seq", {"has": "false", "v": "''", "status": "''", "shown": "CAST(NULL AS VARCHAR)"}, lets, step, "_key AS key, _at AS seq, status, shown AS value")


#: Calls in order of time: pos from 1 for each node.
_TIMED = "(SELECT user_id AS node, epoch_us(ts) AS at_us, event_id AS seq, event_type = 'error' AS error, CAST(floor(value * 1000) AS BIGINT) AS latency, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def _lalb() -> str:
    scale, queue = folds.LocalityWeight.SCALE, 128
    lets = {
        "cost": "CASE WHEN error THEN 500000 ELSE latency END",
        "filled": f"len(q) = {queue}",
        "q1": "CASE WHEN latency <= 0 THEN q WHEN error AND len(q) > 0 THEN list_append(q[1:-2], q[-1] + cost) WHEN error THEN [greatest(cost, 500000)] WHEN filled THEN list_append(q[2:], latency + q[-1]) ELSE list_append(q, latency + coalesce(q[-1], 0)) END",
        "e1": "CASE WHEN latency <= 0 THEN e WHEN error AND len(q) > 0 THEN list_append(e[1:-2], at_us) WHEN NOT error AND filled THEN list_append(e[2:], at_us) ELSE list_append(e, at_us) END",
        "n": "len(q1)",
        "several": "latency > 0 AND n > 1 AND at_us > e1[1]",
        "qps": f"CASE WHEN several AND (n = {queue} OR at_us >= e1[1] + 1000000) THEN greatest({scale}, (n - 1) * 1000000 * {scale} // (at_us - e1[1])) ELSE {scale} END",
        "lat1": "CASE WHEN latency <= 0 THEN lat WHEN several THEN (q1[-1] - q1[1]) // (n - 1) WHEN n = 1 THEN q1[-1] ELSE lat END",
        "w1": "CASE WHEN latency > 0 AND (several OR n = 1) AND lat1 > 0 THEN greatest(1000, qps // lat1) ELSE w END",
    }
    start = {"q": "CAST([] AS BIGINT[])", "e": "CAST([] AS BIGINT[])", "lat": "CAST(0 AS BIGINT)", "w": "CAST(1000 AS BIGINT)", "t": "CAST(0 AS BIGINT)", "s": "CAST(0 AS BIGINT)"}
    step = {"q": "q1", "e": "e1", "lat": "lat1", "w": "w1", "t": "at_us", "s": "seq"}
    return sql_parts.in_order(_TIMED, "node", "pos", start, lets, step, "_key AS node, t AS at_us, s AS seq, w AS weight")


def _limit() -> str:
    after, window, least, most = 37_500_000, 86_400_000_000, 10, 20
    lets = {
        "rem0": f"coalesce(rem, at_us + {after})",
        "smp": "last = 0 OR at_us - last >= 100",
        "wait": "smp AND rst <> 0 AND rst > at_us",
        "fresh": "smp AND rst <> 0 AND rst <= at_us",
        "act": "smp AND NOT wait",
        "m1": "CASE WHEN fresh THEN CAST(-1 AS DOUBLE) ELSE minl END",
        "r1": "CASE WHEN fresh THEN 0 ELSE rst END",
        "rem1": f"CASE WHEN fresh THEN at_us + {after} ELSE rem0 END",
        "b1": "CASE WHEN fresh OR act AND beg = 0 THEN at_us ELSE beg END",
        "c1": "CASE WHEN fresh THEN 0 ELSE calls + CASE WHEN error THEN 0 ELSE 1 END END",
        "g1": "CASE WHEN fresh THEN 0 ELSE good END + CASE WHEN act AND NOT error THEN 1 ELSE 0 END",
        "f1": "CASE WHEN fresh THEN 0 ELSE bad END + CASE WHEN act AND error THEN 1 ELSE 0 END",
        "gu1": "CASE WHEN fresh THEN 0 ELSE good_us END + CASE WHEN act AND NOT error THEN latency ELSE 0 END",
        "fu1": "CASE WHEN fresh THEN 0 ELSE bad_us END + CASE WHEN act AND error THEN latency ELSE 0 END",
        "over": f"at_us - b1 >= {window}",
        "fit": f"act AND g1 + f1 >= {least} AND (over OR g1 + f1 >= {most})",
        "clear": f"fit OR act AND g1 + f1 < {least} AND over",
        "any_good": "fit AND g1 > 0",
        "mean": "CASE WHEN any_good THEN CAST(ceil(CAST(gu1 + fu1 AS DOUBLE) / g1) AS BIGINT) END",
        "qps": "1e6 * c1 / greatest(1, at_us - b1)",
        "m2": "CASE WHEN NOT any_good THEN m1 WHEN m1 <= 0 THEN CAST(mean AS DOUBLE) WHEN mean < m1 THEN trunc(mean * CAST(0.1 AS DOUBLE) + m1 * (1 - CAST(0.1 AS DOUBLE))) ELSE m1 END",
        "q2": "CASE WHEN NOT any_good THEN maxq WHEN qps >= maxq THEN qps ELSE qps * (CAST(0.1 AS DOUBLE) / 10) + maxq * (1 - CAST(0.1 AS DOUBLE) / 10) END",
        "again": "any_good AND rem1 <= at_us",
        "idle": "mean <= m2 * CAST(1.06 AS DOUBLE) OR qps <= q2 / CAST(1.06 AS DOUBLE)",
        "x1": "CASE WHEN NOT any_good OR again THEN x WHEN idle THEN least(CAST(0.3 AS DOUBLE), x + CAST(0.02 AS DOUBLE)) ELSE greatest(CAST(0.06 AS DOUBLE), x - CAST(0.02 AS DOUBLE)) END",
        "l1": "CASE WHEN NOT fit THEN lim WHEN NOT any_good THEN greatest(9, lim // 2) WHEN again THEN greatest(9, CAST(ceil(q2 * m2 / 1e6 * CAST(0.9 AS DOUBLE)) AS BIGINT)) ELSE greatest(9, CAST(trunc(m2 * q2 / 1e6 * (1 + x1)) AS BIGINT)) END",
    }
    zero = "CAST(0 AS BIGINT)"
    start = {"rem": "CAST(NULL AS BIGINT)", "last": zero, "rst": zero, "beg": zero, "calls": zero, "good": zero, "bad": zero, "good_us": zero, "bad_us": zero, "minl": "CAST(-1 AS DOUBLE)", "maxq": "CAST(-1 AS DOUBLE)", "x": "CAST(0.3 AS DOUBLE)", "lim": "CAST(40 AS BIGINT)", "t": zero, "s": zero}
    kept = lambda name: f"CASE WHEN clear THEN 0 ELSE {name} END"
    step = {"rem": "rem1", "last": "CASE WHEN smp THEN at_us ELSE last END", "rst": "CASE WHEN again THEN at_us + 2 * mean ELSE r1 END", "beg": "CASE WHEN clear THEN at_us ELSE b1 END", "calls": kept("c1"), "good": kept("g1"), "bad": kept("f1"), "good_us": kept("gu1"), "bad_us": kept("fu1"), "minl": "m2", "maxq": "q2", "x": "x1", "lim": "l1", "t": "at_us", "s": "seq"}
    return sql_parts.in_order(_TIMED, "node", "pos", start, lets, step, "_key AS node, t AS at_us, s AS seq, lim AS limit_now")


def _decoded() -> str:
    """Best path of three states as a fold that carries each state's score and path."""
    tran = ((0.5, 0.25, 0.2, 0.05), (0.2, 0.5, 0.25, 0.05), (0.25, 0.2, 0.5, 0.05))
    log = lambda p: f"CASE WHEN {p} > 1e-20 THEN log10({p}) ELSE -20.0 END"
    lets = {f"e{j}": log(f"(exp(-(value - {m}) * (value - {m}) / 200.0) / sqrt(2 * 3.14159 * 100.0))") for j, m in enumerate((10.0, 30.0, 60.0))}
    for j in range(3):
        for i in range(3):
            lets[f"s{i}{j}"] = f"b{i} + log10(CAST({tran[i][j]} AS DOUBLE))"
        lets[f"from{j}"] = f"CASE WHEN s0{j} >= s1{j} AND s0{j} >= s2{j} THEN 0 WHEN s1{j} >= s2{j} THEN 1 ELSE 2 END"
    first = (0.5, 0.25, 0.25)
    start = {f"b{j}": "CAST(0 AS DOUBLE)" for j in range(3)} | {f"p{j}": "CAST([] AS INTEGER[])" for j in range(3)}
    step = {f"b{j}": f"CASE WHEN pos = 1 THEN log10(CAST({first[j]} AS DOUBLE)) + e{j} ELSE greatest(s0{j}, s1{j}, s2{j}) + e{j} END" for j in range(3)}
    step |= {f"p{j}": f"list_append(CASE WHEN pos = 1 THEN CAST([] AS INTEGER[]) WHEN from{j} = 0 THEN p0 WHEN from{j} = 1 THEN p1 ELSE p2 END, {j})" for j in range(3)}
    end = f"log10(CAST({tran[0][3]} AS DOUBLE))"
    folded = sql_parts.in_order("(SELECT user_id AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)", "k", "pos", start, lets, step, f"_key, _rn, b0 + {end} AS b0, b1 + {end} AS b1, b2 + {end} AS b2, p0, p1, p2")
    best = f"SELECT *, max(_rn) OVER (PARTITION BY _key) AS n FROM ({folded})"
    path = "CASE WHEN b0 >= b1 AND b0 >= b2 THEN p0 WHEN b1 >= b2 THEN p1 ELSE p2 END"
    return f"SELECT _key AS seq_id, CAST(unnest(range(n)) AS INTEGER) AS pos, unnest({path}) AS state, round(exp(greatest(b0, b1, b2) / n), 6) AS score FROM ({best}) WHERE _rn = n"


_FIELD = "CASE WHEN {0} IS NULL THEN 3 WHEN strlen({0}) < 255 THEN strlen({0}) + 4 ELSE strlen({0}) + 7 END"
ORACLES = {
    "circuit_breaker": _breaker(),
    "auto_limit": _limit(),
    "lalb_weight": _lalb(),
    "hmm_decode": _decoded(),
    "sm_cas": _cas(),
    "memcache_fold": _memcache(),
    "recordio_roundtrip": "SELECT doc_id, CAST(16 + length(CAST(doc_id AS VARCHAR)) + strlen(text) AS BIGINT) AS n_frame, true AS same FROM documents WHERE text IS NOT NULL",
    "mcpack_roundtrip": f"SELECT conv_id, CAST(115 + 8 * count(*) + sum({_FIELD.format('role')}) + sum({_FIELD.format('text')}) AS BIGINT) AS n_bytes, true AS same FROM conversations GROUP BY 1",
    "compress_roundtrip": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS zlib_same, CASE WHEN text IS NOT NULL THEN true END AS gzip_same, CASE WHEN text IS NOT NULL THEN true END AS snappy_same FROM documents",
    "kmeans_assign": f"WITH {_K} SELECT id, label, round(dist, 6) AS dist FROM y",
    "kmeans_step": f"WITH {_K} SELECT label, dim, count(*) AS n, round(avg(e[dim + 1]), 6) AS mean FROM (SELECT label, e, CAST(unnest(range(len(e))) AS INTEGER) AS dim FROM y) GROUP BY 1, 2",
    "gmm_estep": f"WITH {_V} SELECT id, round(sum(0.25 * {_P}), 6) AS density, round(sum(0.25 * {_P}) FILTER (WHERE label = 0) / sum(0.25 * {_P}), 6) AS share FROM v, k GROUP BY id",
    "life_step": "WITH c AS (SELECT DISTINCT CAST(l_orderkey * 7 % 256 AS INTEGER) AS x, CAST(l_partkey % 192 AS INTEGER) AS y FROM lineitem WHERE l_linenumber = 1), s AS (SELECT CAST((x + dx + 256) % 256 AS INTEGER) AS x, CAST((y + dy + 192) % 192 AS INTEGER) AS y, CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 0 END AS own FROM c, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)) SELECT x, y FROM s GROUP BY x, y HAVING count(*) = 3 OR (count(*) = 4 AND max(own) = 1)",
    "balance_grow": "SELECT o_orderkey, x - 100 AS sum_x, y + 100 AS sum_y, y - x + 200 AS link, x // 4 AS prod_x, y * 4 AS prod_y FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS x, o_custkey AS y FROM orders)",
    "sm_counter": "SELECT user_id AS node, event_id AS seq, CAST(coalesce(sum(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS previous FROM events",
    "sm_exchange": "SELECT user_id AS node, event_id AS seq, coalesce(lag(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS previous FROM events",
    "quorum_commit": "SELECT grp, l[CAST(floor(len(l) / 2) AS INTEGER) + 1] AS committed FROM (SELECT grp, list(m ORDER BY m DESC) AS l FROM (SELECT l_suppkey % 11 AS grp, CAST(sum(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY grp, l_suppkey) GROUP BY grp)",
    "log_conflicts": "SELECT log_index, term FROM (SELECT *, max(term) OVER (ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT event_id % 997 AS log_index, max(user_id) AS term FROM events GROUP BY 1)) WHERE b IS NULL OR term >= b",
    "log_range": "SELECT event_id AS log_index, event_type FROM events WHERE event_id BETWEEN 100 AND 199",
    "snapshot_throttle": "SELECT l_suppkey, l_linenumber, l_orderkey, CAST(greatest(0, least(q, 500 - coalesce(b, 0))) AS BIGINT) AS granted FROM (SELECT *, sum(q) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT l_suppkey, l_linenumber, l_orderkey, l_partkey, l_extendedprice, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem))",
    "config_diff": "SELECT s_nationkey, count(*) FILTER (WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0) AS n_added, count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0) AS n_removed FROM supplier GROUP BY 1 HAVING count(*) FILTER (WHERE s_suppkey % 3 <> 0) > 0 AND count(*) FILTER (WHERE s_suppkey % 2 <> 0) > 0",
}
