"""Known answers: hashes, strings, codecs, folds, models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.functions import jsonops, mathops, timeops
from tessera.functions import strings as st
from tessera.operators import assign, folds, kv, metrics, ml, sim, trace
from tessera.operators.kvapi import KvStore
from tessera.session import setting
from tessera.sources import codecs, importers, raftlog, recordio


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"", 0),
        (b"hello world", 2794219650),
        (b"helmo world", 1006697176),
        (b"hello\0 world", 2319902537),
        (b"hello\0 worle", 553904462),
        (bytes((i % 256 - 128) % 256 for i in range(4096)), 2797962408),
        (b"hello w\xab", 615571198),
        (b"hello wo\xab", 623474296),
        (b"hello wor\xab", 4278562408),
        (b"hello worl\xab", 3224633008),
    ],
)
def test_super_fast_hash(data, want):
    assert hs.hash_one(hs.super_fast_kernel, data) == want


@pytest.mark.parametrize(
    ("data", "want"),
    [(bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C), (b"123456789", 0xE3069283)],
)
def test_crc32c(data, want):
    crc = hs.hash_one(hs.crc32c_kernel, data)
    assert crc == want and hs.crc32c_unmask(hs.crc32c_mask(crc)) == crc


@pytest.mark.parametrize(("data", "want"), [(b"", 0), (b"test", 0xBA6BD213), (b"Hello, world!", 0xC0363E43), (b"The quick brown fox jumps over the lazy dog", 0x2E4FF723)])
def test_murmur(data, want):
    assert hs.hash_one(hs.murmur_kernel, data) == want


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_split_string(spark):
    for text, sep, want in [("", "*", []), ("   ", "*", []), ("\t  \ta\t ", "\t", ["", "", "a", ""]), ("\ta\t\nb\tcc", "\n", ["a", "b\tcc"]), (",", ",", ["", ""]), ("a, b ,c", ",", ["a", "b", "c"])]:
        assert one(spark, st.split_string(F.lit(text), sep)) == want
    assert one(spark, st.split_substring(F.lit(" a<br>b <br> c"), "<br>")) == ["a", "b", "c"]
    assert one(spark, st.split_white(F.lit("  a \n b\t"))) == ["a", "b"]


def test_strings(spark):
    assert one(spark, st.underscored(F.lit("FooBar::HTTPServer2-x"))) == "foo_bar_http_server2_x"
    assert [one(spark, st.format_bytes(F.lit(n))) for n in (0, 853, 54 * 1024, 1024 * 1024 * 5 // 2)] == ["0 B", "853 B", "54.0 kB", "2.5 MB"]
    for n in range(12):
        assert one(spark, st.truncate_utf8(F.lit("aé€😀b"), n)) == "aé€😀b".encode()[:n].decode("utf-8", "ignore")
    assert one(spark, st.match_pattern(F.lit("Hello"), "He??o*1*")) is False and one(spark, st.match_pattern(F.lit("Hello1234"), "He??o\\*1*")) is False
    assert one(spark, st.match_pattern(F.lit("Hello*1234"), "He??o\\*1*")) and one(spark, st.match_pattern(F.lit("Helo"), "Hel?o?"))
    assert one(spark, st.wildcard_list(F.lit("abc"), "x;a?c,")) and not one(spark, st.wildcard_list(F.lit("ac"), "a?c"))
    p = one(spark, st.uri_parts(F.lit("http://user:pw@host.org:8080/a/b?x=1&y=2#f")))
    assert tuple(p) == ("http", "user:pw", "host.org", 8080, "/a/b", "x=1&y=2", "f")


def test_numbers(spark):
    assert [one(spark, mathops.log2_floor(F.lit(n))) for n in (0, 1, 2, 3, 8)] == [-1, 0, 1, 1, 3]
    assert [one(spark, mathops.log2_ceiling(F.lit(n))) for n in (0, 1, 2, 3, 8, 9)] == [-1, 0, 1, 2, 3, 4]
    assert [one(spark, mathops.log2_bucket(F.lit(n))) for n in (0, 2, 3, 4, 8, 1 << 40)] == [0, 0, 0, 1, 2, 31]
    assert one(spark, mathops.checked("add", F.lit((1 << 63) - 1), F.lit(1))) is None
    assert one(spark, mathops.checked("divide", F.lit(-7), F.lit(2))) == -3 and one(spark, mathops.checked("divide", F.lit(1), F.lit(0))) is None


def test_addresses(spark):
    number = lambda ip, **k: one(spark, mathops.ipv4_to_int(F.lit(ip), **k))
    dotted = lambda n, **k: one(spark, mathops.int_to_ipv4(F.lit(n).cast("long"), **k))
    assert number("1.1.1.1") == 16843009 and dotted(16843009) == dotted(16843009, wide=True) == "1.1.1.1"
    assert [number(x) for x in ("301.1.1.1", "1.-1.1.1", "1.1.-101.1", "1.1.1", "1.1.1.1.1", "", None)] == [None] * 7
    assert dotted((1 << 32) + 1) == "0.0.0.1" and dotted(None) is None and dotted(None, wide=True) is None
    for n in (0, (1 << 32) - 1, 1 << 32, -1, (1 << 63) - 1, -(1 << 63)):
        assert number(dotted(n, wide=True), wide=True) == n
    assert dotted(1 << 32, wide=True) == "256.0.0.0" and dotted(-1, wide=True) == "-1.255.255.255"
    bad = ("1.301.1.1", "1.-1.1.1", "1.1.1", "1.1.1.1.1", "x.1.1.1", "", "549755813888.0.0.0", "-549755813889.0.0.0", "99999999999999.1.1.1", None)
    assert [number(x, wide=True) for x in bad] == [None] * len(bad)


def test_kv_fixture(spark, tmp_path):
    s = KvStore(spark, str(tmp_path), partitions=4)
    df = lambda pairs: spark.createDataFrame(pairs, "key string, value string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    assert s.create("table_1", 4, 3, 100, nodes=5) == "ok" and s.create("table_1") == "exist" and s.tables() == ["table_1"]
    s.set("table_1", df([("A", "1000"), ("B", "2000")]), -1, now=100)
    s.set("table_1", df([("C", "3000"), ("D", "4000")]), 1, now=100)
    get = lambda now: {r.key: r.value for r in s.get("table_1", keys(*"ABCDE"), now).collect()}
    assert get(100) == {"A": "1000", "B": "2000", "C": "3000", "D": "4000", "E": ""}
    assert get(102) == {"A": "1000", "B": "2000", "C": "", "D": "", "E": ""}
    assert [s.list("table_1", o, n, 100).count() for o, n in ((0, 5), (0, 3), (3, 2))] == [4, 3, 1]
    assert [kv.list_end(4, o, n) for o, n in ((0, 5), (0, 3), (3, 2))] == [True, False, True]
    s.set("table_1", df([("C", "5")]), 0, now=101)
    s.delete("table_1", keys("A", "B", "nope"))
    assert get(10_000) == {"A": "", "B": "", "C": "5", "D": "", "E": ""}
    assert s.set("auto", df([("x", "y")]), 0, 1) == "ok" and s.tables() == ["auto", "table_1"]
    assert s.drop("table_1", "auto") == "ok" and s.tables() == []


def test_kv_store_outlives_itself(spark, tmp_path):
    df = lambda *pairs: spark.createDataFrame(list(pairs), "key string, value string")
    s = KvStore(spark, str(tmp_path), nodes=["a", "b", "c"])
    assert s.flush("t") == "not_found" and s.create("t", 2, 2, nodes=3) == "ok" and s.flush("t") == "ok"
    s.set("t", df(("k", "old"), ("gone", "x")), -1, now=1)
    again = KvStore(spark, str(tmp_path), nodes=["a", "b", "c"])
    assert again.tables() == ["t"] and again.seq >= s.seq
    again.set("t", df(("k", "new")), -1, now=2)
    read = lambda st, now=5: {r.key: r.value for r in st.table("t").where(f"expired = 0 OR expired > {now}").collect()}
    assert read(again) == {"k": "new", "gone": "x"} == read(KvStore(spark, str(tmp_path)))
    assert again.drop("t", versions={"t": 77}) == "version_mismatch" and again.drop("t", "nope") == "not_found"
    assert again.drop("t", versions={"t": again.catalog["t"]["version"]}) == "ok" and not (tmp_path / "t").exists()
    assert again.create("t") == "ok" and again.table("t").collect() == [] and again.get("t", df(("k", "")), 1).first().value == ""
    again.set("t", df(("k", "3")), 10, now=100)
    again.set("t", df(("m", "4")), 0, now=100)
    assert again.compact("t", now=200) == (1, 1) and read(again) == {"m": "4"} == read(KvStore(spark, str(tmp_path)))
    assert again.metas(node="a").count() == 1 and again.metas(["nope"]).count() == 0
    say = lambda line: again.run(line, now=300)
    assert [say(x) for x in ("create_table u 2", "set u 'a b' 1", "get u 'a b'", "get u c", "list u 0 9", "del u 'a b'", "get u 'a b'", "get nope x", "table_info t", "drop u", "drop u", "jump")] == ["ok", "ok", "1", "not exist", "a b 1", "ok", "not exist", "not_found", "0 1 0", "ok", "not_found", "unknown command"]
    assert say("info") == "t 1 1"


def test_metrics(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 10_001)] * 2, "v long").withColumn("k", F.lit(1))
    r = metrics.nearest_rank(v, ["k"], "v", {f"p{i}": i / 10 for i in range(1, 11)}).first()
    assert [r[f"p{i}"] for i in range(1, 11)] == [1000 * i for i in range(1, 11)]
    neg = spark.createDataFrame([(-2,), (-2,), (-2,)], "x long")
    assert neg.agg(metrics.truncated_average(F.col("x"))).first()[0] == -2
    big = spark.createDataFrame([(1 << 40,), (None,)], "x long")
    assert big.agg(metrics.truncated_average(F.col("x"))).first()[0] == (1 << 31) - 1
    few = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x long")
    assert tuple(few.agg(metrics.adder(F.col("x")), metrics.maxer(F.col("x")), metrics.miner(F.col("x"))).first()) == (10, 4, 1)
    assert few.where("false").agg(metrics.adder(F.col("x"))).first()[0] == 0


def test_window_difference_equals_frames(spark):
    rng = random.Random(4)
    t = spark.createDataFrame([("a", i, rng.randrange(100)) for i in range(200)], "k string, tick long, s long")
    a = metrics.windowed(t, ["k"], "tick", 7, {"w": F.sum("s")}).select("tick", "w")
    b = metrics.windowed_by_difference(t, ["k"], "tick", 7, "s").select("tick", F.col("window_sum").alias("w"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    with pytest.raises(ValueError):
        metrics.windowed(t, ["k"], "tick", 3601, {})


def test_sets_and_rules(spark):
    a = spark.createDataFrame([(x,) for x in (1, 1, 2, 3)], "x int")
    b = spark.createDataFrame([(x,) for x in (1, 2, 2)], "x int")
    assert sorted(r.x for r in trace.multiset_union(a, b).collect()) == [1, 1, 2, 2, 3]
    assert not trace.includes(a, b).first()[0] and trace.includes(a, b.distinct()).first()[0]
    p = spark.createDataFrame([("/v1/x/y",), ("/v1/x",), ("/other",)], "p string")
    got = {r.p: r.rule for r in trace.match_rules(p, "p", ["/v1/*", "/v1/*/y", "/v1/x"]).collect()}
    assert got == {"/v1/x/y": "/v1/*/y", "/v1/x": "/v1/x", "/other": None}


def test_weighted_round_robin_is_exact(spark):
    s = spark.createDataFrame([("a", 3), ("b", 2), ("c", 7)], "server string, weight long")
    r = spark.range(24).withColumnRenamed("id", "i")
    got = {x.server: x["count"] for x in assign.weighted_round_robin(r, "i", s).groupBy("server").count().collect()}
    assert got == {"a": 6, "b": 4, "c": 14}
    tags = spark.createDataFrame([(t,) for t in ("3", "1ab", "-1", "0", "200000000")], "t string")
    assert [r[0] for r in tags.select(assign.valid_weight(F.col("t"))).collect()] == [3, None, None, None, 200000000]


def run_breaker(percent):
    b = folds.CircuitBreaker(long=1000, short=500, long_percent=5, short_percent=10)
    rng = random.Random(1)
    return [b.on_call_end(rng.random() < percent, 1000) for _ in range(3000)]


def test_circuit_breaker():
    assert all(run_breaker(0.03)) and not run_breaker(0.5)[-1]
    assert folds.isolation_ms(10, 200) == 400 and folds.isolation_ms(40_000, 200) == 100


def test_breaker_windows():
    w = folds.EmaRecorder(100, 5)
    # while it fills, as many errors as the percentage allows stay healthy; the next doesn't
    assert [w.on_call_end(True, 10) for _ in range(6)] == [True] * 5 + [False]
    # a success never breaks, whatever the window allows
    assert folds.EmaRecorder(10, 5).on_call_end(False, 10) and not folds.EmaRecorder(10, 5).on_call_end(True, 10)
    # a full window without a latency has no allowance
    w = folds.EmaRecorder(4, 50)
    assert [w.on_call_end(True, 7) for _ in range(5)] == [True, True, False, False, False]
    # the cost of an error counts to twice the average latency; under 500 it is forgotten at a success, else it decays
    w = folds.EmaRecorder(10, 50)
    for _ in range(10):
        w.on_call_end(False, 100)
    assert w.latency == 100 and w.on_call_end(True, 10_000) and w.cost == 200
    assert w.on_call_end(False, 100) and w.cost == 0
    assert [w.on_call_end(True, 10_000) for _ in range(3)] == [True, True, False] and w.cost == 600
    assert w.on_call_end(False, 100) and w.cost == int(600 * 0.02**0.1)
    w.reset()
    assert (w.cost, w.latency, w.seen) == (0, 100, 10)
    young = folds.EmaRecorder(10, 50)
    young.on_call_end(True, 5)
    young.reset()
    assert (young.seen, young.errors, young.latency) == (0, 0, 0)
    b = folds.CircuitBreaker(long=10, short=10, long_percent=10, short_percent=10)
    assert [b.on_call_end(True, 1, overload=True), b.on_call_end(True, 1), b.on_call_end(True, 1), b.on_call_end(False, 1)] == [True, True, False, False]
    assert b.isolated == 1 and b.duration_ms == 200 and b.on_call_end(True, 1, overload=True)
    b.reset(now_ms=50)
    assert b.on_call_end(False, 1)


def test_auto_limit():
    def run(n, latency, gap=1000, error=lambda i: False, **kw):
        a = folds.AutoLimit(least=10, most=20, **kw)
        return a, [a.add(1 + i * gap, error(i), latency(i)) for i in range(n)]

    a, seen = run(400, lambda i: 50_000)
    # 20 samples 1 ms apart, the first at the window's start: 20 calls in 19 ms at 50 ms each
    assert seen[18] == 40 and seen[19] == int(50_000 * (20 * 1e6 / 19_000) / 1e6 * 1.3) and a.explore == 0.3
    loaded, _ = run(4000, lambda i: 50_000 + 40 * i)
    assert loaded.explore == pytest.approx(0.06)
    failed, got = run(40, lambda i: 50, error=lambda i: True)
    assert got[19] == 20 and got[39] == 10 and folds.AutoLimit(floor=9).floor == 9
    # failures weigh on the latency of the good calls
    punished, _ = run(20, lambda i: 1000, error=lambda i: i % 2 == 0)
    assert punished.min_latency == 2000
    # from time to time the limit drops and the least latency is measured anew
    again, limits = run(2000, lambda i: 50_000 if i < 900 else 80_000, remeasure_us=2_000_000)
    assert again.min_latency == 80_000 and min(limits[40:]) < max(limits)
    # a window that doesn't fill in time is left out
    slow, limits = run(100, lambda i: 50, gap=400_000)
    assert set(limits) == {40} and slow.min_latency == -1.0


def test_locality_weight():
    w = folds.LocalityWeight(queue=4, floor=1000, timeout_us=500_000)
    scale = w.SCALE
    assert scale == 1008680231
    assert w.update(1_000_000, False, 2000) == scale // 2000
    assert w.update(1_500_000, False, 4000) == scale // 4000
    # full: three calls in a second and a half
    w.update(2_000_000, False, 4000)
    assert w.update(2_500_000, False, 4000) == (3 * 1_000_000 * scale // 1_500_000) // 4000
    # a failure makes the last call slower by the timeout
    assert w.update(2_600_000, True, 10) == (3 * 1_000_000 * scale // 1_600_000) // ((3 * 4000 + 500_000) // 3)
    first = folds.LocalityWeight()
    assert first.update(10, True, 5) == max(1000, scale // 500_000)
    # calls in flight that wait long lower the weight
    w = folds.LocalityWeight()
    w.update(1_000_000, False, 1000)
    w.begin(1_000_000)
    w.begin(1_000_500)
    before = w.weight
    assert w.update(1_030_000, False, 29_500) == w.base * int(29_500 * 1.5) // 30_000 or w.weight <= before
    assert w.update(1_030_001, False, 0) == w.weight


def test_atomic_and_memcache(spark):
    ops = spark.createDataFrame([(1, 1, "get", 0, 0), (1, 2, "cas", 5, 0), (1, 3, "cas", 6, 4), (1, 4, "exchange", 9, 0), (1, 5, "get", 0, 0)], "id long, seq long, op string, value long, expected long")
    assert [tuple(r)[2:] for r in folds.atomic_map(ops).orderBy("seq").collect()] == [(True, 0), (True, 0), (False, 5), (True, 5), (True, 9)]
    m = [("set", "5", 0), ("incr", "", 3), ("append", "0", 0), ("add", "x", 0), ("decr", "", 100), ("set", "z", 99), ("delete", "", 0), ("get", "", 0)]
    df = spark.createDataFrame([(1, i, o, v, n) for i, (o, v, n) in enumerate(m)], "key long, seq long, op string, value string, number long")
    assert [tuple(r)[2:] for r in folds.memcache(df).orderBy("seq").collect()] == [("ok", "5"), ("ok", "8"), ("ok", "80"), ("not_stored", None), ("ok", "0"), ("exists", None), ("ok", None), ("not_found", None)]


def test_memcache_flush(spark):
    m = [(1, 1, "set", "a"), (2, 2, "set", "b"), (1, 3, "touch", ""), (9, 4, "flush", ""), (1, 5, "get", ""), (2, 6, "add", "c"), (2, 7, "get", ""), (1, 8, "touch", ""), (1, 9, "version", "")]
    df = spark.createDataFrame([(k, i, o, v, 0) for k, i, o, v in m], "key long, seq long, op string, value string, number long")
    got = {r.seq: (r.status, r["value"]) for r in folds.memcache(df).collect()}
    assert got == {1: ("ok", "a"), 2: ("ok", "b"), 3: ("ok", None), 5: ("not_found", None), 6: ("ok", "c"), 7: ("ok", "c"), 8: ("not_found", None), 9: ("ok", "1")}


SAMPLES = [[0.0, 0.2, 0.4], [0.3, 0.2, 0.4], [0.4, 0.2, 0.4], [0.5, 0.2, 0.4], [5.0, 5.2, 8.4], [6.0, 5.2, 7.4], [4.0, 5.2, 4.4], [10.3, 10.4, 10.5], [10.1, 10.6, 10.7], [11.3, 10.2, 10.9]]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id long, features array<double>")


def numpy_kmeans(x, k):
    c = x[[int(i * len(x) / k) for i in range(k)]].copy()
    last, same = 0.0, 0
    for _ in range(100):
        d = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
        lab, cost = d.argmin(axis=1), d.min(axis=1).mean()
        for j in range(k):
            if (lab == j).any():
                c[j] = x[lab == j].mean(axis=0)
        same += abs(last - cost) < 0.001 * last
        last = cost
        if same >= 3:
            break
    return c


def test_kmeans(samples):
    km = ml.KMeans(4).fit(samples)
    assert np.allclose(km.centroids, numpy_kmeans(np.array(SAMPLES), 4)) and ml.KMeans.from_json(km.to_json()) == km


def test_gmm(samples):
    g = ml.Gmm(3).fit(samples)
    assert sum(g.priors) == pytest.approx(1.0) and ml.Gmm.from_json(g.to_json()) == g
    got = [r[0] for r in samples.orderBy("id").select(g.density(F.col("features"))).collect()]
    assert np.allclose(got, g.numpy_density(np.array(SAMPLES)))
    assert min(got) > 0


def test_hmm(spark):
    cuts = [(0, 2), (2, 5), (5, 9), (9, 10)]
    seqs = spark.createDataFrame([(i, SAMPLES[a:b]) for i, (a, b) in enumerate(cuts)], "seq_id long, obs array<array<double>>")
    g = lambda m: ml.Gmm(1, [1.0], [[m] * 3], [[4.0] * 3], [1e-10] * 3)
    h = ml.Hmm(2, 1, [0.6, 0.4], [[0.5, 0.4, 0.1], [0.3, 0.6, 0.1]], [g(0.0), g(9.0)])
    for obs in (SAMPLES[2:6], SAMPLES[:1]):
        x = np.array(obs)
        best = -1e9
        for path in np.ndindex(*[2] * len(x)):
            e = [ml._log10(m.numpy_density(x)) for m in h.models]
            s = np.log10(h.init_p[path[0]]) + sum(e[q][t] for t, q in enumerate(path)) + sum(np.log10(h.tran[a][b]) for a, b in zip(path, path[1:], strict=False)) + np.log10(h.tran[path[-1]][2])
            best = max(best, s)
        assert h.viterbi(x)[1] == pytest.approx(np.exp(best / len(x)))
    assert h.decode(seqs).count() == 10 and ml.Hmm.from_json(h.to_json()) == h
    assert {r.seq_id: r.score for r in h.probability(seqs).collect()} == pytest.approx({i: h.viterbi(np.array(SAMPLES[a:b]))[1] for i, (a, b) in enumerate(cuts)})
    # places of long sequences don't run into the next sequence
    long = spark.createDataFrame([(0, [[0.0]] * 1_000_001), (1, [[1.0]])], "seq_id long, obs array<array<double>>")
    ids = h._frames(long).where("pos = 1000000 OR seq_id = 1").select("id").collect()
    assert len({r.id for r in ids}) == 2


def test_life(spark):
    cells = lambda c: spark.createDataFrame(sorted(c), "x int, y int")
    step = lambda c: {tuple(r) for r in sim.life_step(cells(c), 8, 6).collect()}
    blinker, block = {(1, 2), (2, 2), (3, 2)}, {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert step(blinker) == {(2, 1), (2, 2), (2, 3)} and step(step(blinker)) == blinker and step(block) == block
    glider = {(6, 4), (7, 5), (5, 0), (6, 0), (7, 0)}
    now = glider
    for _ in range(4):
        now = step(now)
    assert now == {((x + 1) % 8, (y + 1) % 6) for x, y in glider}
    out, seen = sim.life_run(cells(block), 8, 6, 30)
    assert seen == [4] * 10 and out.count() == 4
    assert [r.line for r in sim.render(cells(blinker), 5, 4).orderBy("y").collect()][2] == ".###."


def test_balance(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    row = lambda kind, x, y, c: tuple(spark.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(sim.grow(kind, *lit(x, y, c)))]).first())
    assert row("sum", -1, 1, 1) == (-2, 2) and row("sum", -2, 2, 100) == (-102, 102)
    assert row("prod", 1.0, 1.0, 2.0) == (0.5, 2.0) and row("prod", 0.5, 2.0, 4.0) == (0.125, 8.0)


def test_recordio():
    rng = random.Random(7)
    recs = [({f"m{j}": rng.randbytes(rng.randrange(9)) for j in range(rng.randrange(3))}, rng.randbytes(rng.randrange(60))) for _ in range(50)]
    frames = [recordio.encode(p, m) for m, p in recs]
    assert list(recordio.decode(b"".join(frames))) == recs
    broken = bytearray(b"".join(frames))
    broken[len(frames[0]) + 5] ^= 0xFF
    assert list(recordio.decode(bytes(broken))) == recs[:1] + recs[2:]
    assert list(recordio.decode(b"".join(frames)[:-1])) == recs[:-1]


def test_recordio_files(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(recordio.encode(b"one", {"k": b"v"}) + recordio.encode(b"two"))
    got = sorted((bytes(r.payload), {k: bytes(v) for k, v in r.metas.items()}) for r in recordio.read(spark, str(tmp_path)).collect())
    assert got == [(b"one", {"k": b"v"}), (b"two", {})]


def test_recordio_sink(spark, tmp_path):
    payloads = [bytes([i, 0, 255, 10, 200]) * i for i in range(20)]
    recordio.write(spark.createDataFrame([(p,) for p in payloads], "payload binary").repartition(3), str(tmp_path / "out"))
    assert sorted(bytes(r.payload) for r in recordio.read(spark, str(tmp_path / "out")).collect()) == sorted(payloads)


def test_log_segments(spark, tmp_path):
    raw = [raftlog.entry(5 + i, 1, b"x" * i, i % 2) for i in range(4)]
    (tmp_path / raftlog.segment_name(1, 3)).write_bytes(b"".join(raw[:3]))
    (tmp_path / raftlog.segment_name(4)).write_bytes(raw[3] + raw[2][:-1])
    (tmp_path / "log_meta").write_bytes(b"?")
    assert [tuple(r) for r in raftlog.read(spark, str(tmp_path)).orderBy("log_index").collect()] == [(i + 1, 5 + i, 1, b"x" * i) for i in range(4)]
    for bad, last in ((raw[1][:10] + b"?" + raw[1][11:], None), (raw[2][:-1] + b"y", None), (raw[0], 2)):
        with pytest.raises(ValueError):
            list(raftlog.entries(bad, 1, last))


def test_codecs(spark, tmp_path):
    v = {"a": 1, "b": [1, 2], "c": [{"x": 1, "y": "s"}, {"x": 2, "y": "t"}], "d": {"e": None, "f": True}, "g": 1.5, "h": b"\0raw", "i": ["x", 1], "j": []}
    assert codecs.unpack(codecs.pack(v)) == v
    assert codecs.redis_command("set 'a b' \"c\\\"d\" ''") == b'*4\r\n$3\r\nset\r\n$3\r\na b\r\n$3\r\nc"d\r\n$0\r\n\r\n'
    assert codecs.redis_reply(b"*4\r\n:7\r\n$-1\r\n+OK\r\n$2\r\nhi\r\n")[0] == [7, None, "OK", b"hi"]
    seqs = [SAMPLES[:2], SAMPLES[2:5], SAMPLES[5:6]]
    assert codecs.read_sequences(codecs.sequence_bytes(seqs)) == seqs and codecs.read_labels(codecs.label_bytes([3, -1, 0])) == [3, -1, 0]
    (tmp_path / "m.bin").write_bytes(codecs.matrix_bytes(SAMPLES))
    assert [list(r.features) for r in codecs.read_matrix(spark, str(tmp_path)).orderBy("sample_id").collect()] == SAMPLES


def test_mcpack_widths():
    import struct

    v = {"a": np.int8(-3), "b": np.int16(-300), "c": np.int32(-70_000), "d": np.int64(-(1 << 40)), "e": np.uint8(200), "f": np.uint16(60_000), "g": np.uint32(4_000_000_000), "h": np.uint64((1 << 64) - 1), "i": np.float32(0.5), "j": 0.1, "k": [np.int16(1), np.int16(-2)], "l": [np.float32(1.5)], "m": (1 << 63) + 1, "n": True}
    raw = codecs.pack(v)
    assert codecs.unpack(raw) == {k: ([y.item() for y in x] if isinstance(x, list) else x.item() if isinstance(x, np.generic) else x) for k, x in v.items()}
    assert codecs.pack(np.int32(5), "x") == b"\x14\x02x\0" + struct.pack("<i", 5)
    # a deleted field is stepped over, an unknown fixed one has no value
    body = struct.pack("<I", 3) + b"\x04\x02d\0" + bytes(4) + b"\x72\x02u\0" + bytes(2) + codecs.pack(1, "z")
    assert codecs.unpack(b"\x10\x00" + struct.pack("<I", len(body)) + body) == {"u": None, "z": 1}
    with pytest.raises(ValueError):
        codecs.unpack(b"\x18\x00\x01")


def test_text_functions(spark):
    tok = lambda s, *a, **k: one(spark, st.quoted_tokens(F.lit(s), *a, **k))
    assert tok("this is a test", " ") == ["this", "is", "a", "test"] and tok(" a  b ", " ", keep_delims=True) == [" ", "a", " ", " ", "b", " "]
    assert tok("foo=bar, 'x, y'=\"\\\"q\\\"\" z", ", ", "'\"") == ["foo=bar", "'x, y'=\"\\\"q\\\"\"", "z"] and tok("a 'open b", " ", "'") == ["a", "'open b"] and tok("", " ") == []
    assert one(spark, st.rfind(F.lit("abcabc"), F.lit("bc"))) == 4 and one(spark, st.find(F.lit("abc"), F.lit("z"))) == -1
    assert [tuple(one(spark, st.hex_to_int(F.lit(x)))) for x in ("-0x8000000000000000", "0x7fffffffffffffff", "8000000000000000", "", "0x", "g1")] == [(True, -(1 << 63)), (True, (1 << 63) - 1), (False, None), (False, None), (False, None), (False, None)]
    assert [one(spark, st.to_unsigned(F.lit(x)))["ok"] for x in ("18446744073709551615", "18446744073709551616", "-1", " 1", "7")] == [True, False, False, False, True]
    assert one(spark, st.encode_name(F.lit("1a b.é"))) == "_Z049_a_Z032_b_Z046__Z195__Z169_" and one(spark, st.decode_name(F.lit("_Z049_a_Z032_b_Z300_"))) == "1a b_Z300_"
    assert one(spark, st.utf16_offset(F.lit("a😀b"), F.lit(2))) == 3 and one(spark, st.utf8_offset(F.lit("a😀b"), F.lit(2))) == 5


def test_times_and_bytes(spark):
    us = lambda s: one(spark, timeops.parse_time(F.lit(s)))
    assert us("1970-01-02") == timeops.DAY and us("Thu, 01 Jan 1970 00:00:01 GMT") == 1_000_000 == us("Thu Jan 01 00:00:01 1970 UTC") and us("1969-12-31T23:59:59Z") == -1_000_000 and us("nope") is None
    parts = {k: one(spark, c) for k, c in timeops.span_parts(F.lit(-90_061_001_001)).items()}
    assert parts == {"days": -1, "hours": -25, "minutes": -1501, "seconds": -90061, "ms": -90061001, "ms_up": -90061001}
    assert bytes(one(spark, hs.big_endian(F.lit(258), 4))) == b"\0\0\1\2" and one(spark, hs.from_big_endian(F.lit(b"\xff" * 8))) == -1
    words = F.array(*[F.lit(x).cast("long") for x in (0, -(1 << 63))])
    first = lambda w, a, b: one(spark, mathops.bits_first(w, F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert first(words, 0, 128) == 127 and first(words, 0, 127) == 127 and first(words, 0, 100) == 100
    assert one(spark, mathops.bits_set(words, F.lit(127).cast("long"), on=False)) == [0, 0] and one(spark, mathops.bits_get(words, F.lit(127).cast("long")))


def test_json(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])
    p = lambda js: one(spark, jsonops.parse(F.lit(js), schema, ("s",), ("b",)))
    good = p('{"i": "12", "s": "x", "b": "aGk=", "more": [1]}')
    assert good["ok"] and good["value"]["i"] == 12 and bytes(good["value"]["b"]) == b"hi"
    assert not p('{"i": 1}')["ok"] and p('{"i": "x", "s": "y"}')["value"]["i"] is None and p('{"i": "x", "s": "y"}')["ok"]


def test_importers(spark, tmp_path):
    (tmp_path / "kv.csv").write_text("".join(f"k{i}, v{i} ,rest\n" for i in range(20)) + "short\n")
    got = [tuple(r) for r in importers.read_slice(spark, str(tmp_path / "kv.csv"), 3, 4).collect()]
    assert got == [(f"k{i}", f"v{i}") for i in range(3, 7)]
    many = tmp_path / "many"
    importers.save_pairs(spark.createDataFrame([(f"{i:03}", str(i)) for i in range(200)], "key string, value string").coalesce(1), str(many))
    with setting(spark, "spark.sql.files.maxPartitionBytes", "256"):
        assert [tuple(r) for r in importers.read_slice(spark, str(many), 150, 3).collect()] == [(f"{i:03}", str(i)) for i in (150, 151, 152)]
    files = importers.list_files(spark, str(tmp_path), "*.csv").collect()
    assert [r.path.rsplit("/", 1)[1] for r in files] == ["kv.csv"] and files[0]["size"] == (tmp_path / "kv.csv").stat().st_size
    importers.dump_requests(spark.range(50).withColumnRenamed("id", "n"), str(tmp_path / "dump"), 1.0, 1, per_file=5, files=3, order="n")
    back = importers.read_dump(spark, str(tmp_path / "dump"), "n long")
    assert sorted(r.n for r in back.collect()) == list(range(35, 50)) and back.select("file").distinct().count() == 3
    state = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    importers.save_snapshot(state, str(tmp_path / "snap"), 7)
    importers.save_snapshot(state.where("k = 'a'"), str(tmp_path / "snap"), 12)
    loaded, at = importers.load_snapshot(spark, str(tmp_path / "snap"))
    assert at == 12 and [tuple(r) for r in loaded.collect()] == [("a", 1)]
    a, b = importers.synthetic(spark, 5, 3), importers.synthetic(spark, 5, 3)
    assert a.exceptAll(b).count() == 0
    js = '[{"Service": {"Address": "10.0.0.1", "Port": 80, "Tags": ["1/3", "x"]}}]'
    assert [tuple(x) for x in one(spark, importers.consul(F.lit(js)))] == [("10.0.0.1", 80, "1/3")]


def test_hmm_train_has_the_default_bound(spark, sf, monkeypatch):
    from tessera.plans import learn_plans

    seen = []
    monkeypatch.setattr(ml.Hmm, "fit", lambda self, seqs: seen.append(self.max_iter) or self)
    monkeypatch.setattr(ml.Hmm, "decode", lambda self, seqs: seqs)
    learn_plans.hmm_train(spark, sf)
    assert seen == [ml.Hmm(3, 1).max_iter]


def test_kmeans_train_takes_whole_embeddings(spark, sf):
    from tessera.plans import learn_plans
    from tessera.session import table

    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    got = {r["id"]: (r["label"], r["dist"]) for r in learn_plans.kmeans_train(spark, sf).collect()}
    labels = np.array([got[r["vec_id"]][0] for r in rows])
    fitted = ml.KMeans(4).fit(spark.createDataFrame([(r["vec_id"], list(map(float, r["embedding"]))) for r in rows], "id long, features array<double>"))
    dist = np.sqrt(((x[:, None] - np.array(fitted.centroids)[None]) ** 2).sum(axis=2))
    assert (dist.argmin(axis=1) == labels).all()
    assert [got[r["vec_id"]][1] for r in rows] == pytest.approx(dist.min(axis=1).tolist())
