import html
import random
import re
import textwrap
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import nasty_rows, sentence  # noqa: F401  (tests/llm/conftest.py)

from tessera.llm import decontaminate, langid, licenses, maintext, mixing, neardup, pii, repeats, tokencount, topk
from tessera.llm.queries import oracle_sql, queries
from tessera.session import table


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeats_equal_brute_force(spark, nasty, nothing, sf):
    for df in (nasty, table(spark, sf, "documents")):
        assert rows(repeats.remove_repeats(df)) == brute.repeats(pairs(df))
    assert repeats.remove_repeats(nothing).collect() == []
    import hashlib

    digests = sorted((r.doc_id, hashlib.sha256(r.kept).hexdigest(), len(r.spans)) for r in repeats.remaining(nasty.where("doc_id IS NOT NULL")).collect())
    assert digests == sorted((r.doc_id, r.kept_sha256, r.n_spans) for r in repeats.remove_repeats(nasty.where("doc_id IS NOT NULL")).collect())


def test_repeats_with_chunked_cores(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 4)
    line = sentence(5, 30)
    data = [(i, f"{sentence(100 + i, 12)} {line} {sentence(200 + i, 12)}") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(repeats.remove_repeats(df)) == brute.repeats(data)


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_BLOCK", 700)
    data = [(1, sentence(1, 400)), (2, "head " + sentence(1, 400)[500:2000] + " tail"), (3, sentence(1, 400))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(repeats.remove_repeats(df)) == brute.repeats(data)


def test_deep_shallow_sorts():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(400)) * 3 + b"c" * 500
    starts = np.arange(len(text) - 199)
    order, cls = repeats.deep_shallow(text, starts)
    strings = [text[s : s + 200] for s in starts[order]]
    assert strings == sorted(strings)
    for k in range(1, len(strings)):
        assert (cls[k] == cls[k - 1]) == (strings[k] == strings[k - 1])


def test_near_duplicates_equal_brute_force(spark, nasty, nothing, sf):
    for df in (nasty, table(spark, sf, "documents")):
        assert rows(neardup.groups(df)) == brute.near(pairs(df))
    assert neardup.groups(nothing).collect() == []


@pytest.mark.parametrize("per_class", [0, 1000])
def test_near_duplicates_of_a_drifting_group(spark, monkeypatch, per_class):
    """Every text differs a little from the next, the ends by a lot: components need links beyond one hub."""
    monkeypatch.setattr(neardup, "PAIRS_PER_CLASS", per_class)
    words = sentence(9, 200).split()
    data = []
    for i in range(40):
        words[(i * 37) % 200] = f"new{i}"
        data.append((i, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(neardup.groups(df)) == brute.near(data)


@pytest.mark.parametrize("k, n", [(1, 400), (6, 200), (60, 60)])
def test_near_duplicates_recall_at_the_threshold(spark, k, n):
    """Pairs of 7 k shingles each with 6 k in common are similar by exactly 75 of 100; one word more apart they aren't."""
    data = []
    for i in range(n):
        words = [f"p{i}w{j}" for j in range(7 * k + 4)]
        far = 1 if i % 4 == 0 else 0
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 6 * k + 4 - far] + [f"q{i}w{j}" for j in range(k + far)]))]
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == (2 * i + 1 if i % 4 == 0 else 2 * i) and got[2 * i] == 2 * i for i in range(n))


def test_near_duplicates_leave_no_files(spark, nasty):
    import pathlib

    from tessera.session import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    neardup.groups(nasty).collect()
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"rows", "components"}


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 300, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)])
        sig = neardup.super_minhash(np.repeat([0, 1], n), np.concatenate([a, b]), 2, 512)
        assert np.isfinite(sig).all()
        true = (n // 2) / (2 * n - n // 2)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.08


def test_drop_near_duplicates_keeps_one(nasty, nothing):
    kept = neardup.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[8] == 0 and ids[7] == 1
    assert ids[4] == ids[5] == ids[6] == 1 and ids[None] == 1
    assert neardup.drop_near_duplicates(nothing).collect() == []


def test_pii_equals_brute_force(spark, nasty, nothing, sf):
    for df in (nasty, table(spark, sf, "documents")):
        got = rows(pii.report(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"))
        assert got == sorted(((i, *brute.pii(t)) for i, t in pairs(df)), key=str)
    assert pii.report(nothing).collect() == []


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@x.org 1.2.3.{i % 300} +49 30 {i:07d}" for i in range(700)) + " " + "1 2" * 3000 + "-" + "a" * 20_000 + "@"
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(got)[1:7] == brute.pii(text)[:6]


def test_pii_disclosing_terms(spark):
    data = [(i, f"{sentence(i, 3)} wizardname wrote boss@corp.example.com {sentence(50 + i, 3)}") for i in range(4)]
    data += [(10, "the wizardname was here"), (11, "nothing at all here")] + [(20 + i, sentence(90 + i, 20)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[10] == "term:4:14" and got[11] == "" and "term:" in got[0] and got[0].startswith("email:")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[10] == "the  was here" and "[EMAIL]" in clean[0] and "wizardname" not in clean[0] and clean[11] == data[5][1]


def test_pii_terms_of_repeated_rows(spark):
    data = [(i, f"{sentence(i, 3)} wizardname wrote boss@corp.example.com {sentence(50 + i, 3)}") for i in range(4)]
    data += [(10, "the wizardname was here")] + [(20 + i, sentence(90 + i, 20)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    one = {tuple(r) for r in pii.report(df).collect()}
    thrice = pii.report(df.unionByName(df).unionByName(df)).collect()
    assert len(thrice) == 3 * len(data) and {tuple(r) for r in thrice} == one and any("term:" in r.spans for r in thrice)


def test_sanitise_keeps_rows_and_columns(nasty, nothing):
    out = pii.sanitise(nasty)
    assert out.dtypes == nasty.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[12].text == "mail [EMAIL] or [PHONE], [CARD], [IP] é" and got[12].n_chars == len(got[12].text)
    assert got[4].text is None and got[5].text == ""
    assert pii.sanitise(nothing).collect() == []


def test_decontamination_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars < 1500")
    items = table(spark, sf, "benchmark")
    want = brute.leaks(pairs(docs), [(r.item_id, r.text) for r in items.collect()])
    assert want and rows(decontaminate.leaks(docs, items)) == want


def test_decontamination_recall_at_the_threshold(spark, nasty, nothing):
    rng = random.Random(5)
    items = [(i, sentence(300 + i, 24 + i % 30)) for i in range(40)]
    docs = []
    for i, t in items:
        for k in range(3):
            w = t.split()
            for _ in range(decontaminate.max_edits(len(w))):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + (kind > 0)] = [] if kind == 1 else ["edit"]
            docs.append((i * 10 + k, f"{sentence(900 + i, 30)}\n{' '.join(w).upper()}, {sentence(800 + i, 20)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (77, None), (78, " ,. "), (None, items[0][1])], "item_id long, text string")
    got, want = rows(decontaminate.leaks(df, b)), brute.leaks(docs, [*items, (None, items[0][1])])
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert decontaminate.drop_leaking(df, b).count() <= len(docs) - len({r[0] for r in got})
    assert decontaminate.drop_leaking(nasty, b).count() == nasty.count()
    assert decontaminate.leaks(nasty, b.where("false")).collect() == [] and decontaminate.leaks(nothing, b).collect() == []


@pytest.mark.parametrize("kind", ["dropped", "replaced", "every other word"])
@pytest.mark.parametrize("length", [40, 60, 100, 200])
@pytest.mark.parametrize("led", [False, True])
def test_decontamination_of_passages_edited_in_front(length, kind, led):
    """All of the e edits in front; the passage at the row's start or after other words."""
    texts = [sentence(5000 + 7 * i, length) for i in range(60)]
    e = decontaminate.max_edits(length)
    docs = []
    for i, t in enumerate(texts):
        w = t.split()
        if kind == "dropped":
            w = w[e:]
        elif kind == "replaced":
            w[:e] = [f"new{i}x{k}" for k in range(e)]
        else:
            w[1 : 2 * e : 2] = [f"new{i}x{k}" for k in range(e)]
        docs.append((sentence(9000 + i, 30) + " " if led else "") + " ".join(w) + " " + sentence(7000 + i, 20))
    got = {(r, i) for r, i, _ in decontaminate.Items(list(enumerate(texts))).find(pa.array(docs))}
    assert len({(i, i) for i in range(60)} & got) == 60


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 19, 23])
def test_decontamination_of_short_items(length):
    """Every passage within the bound, edits anywhere, and no other; words of the documents don't stand in the items but by chance."""
    rng = random.Random(length)
    items = [" ".join(f"i{k}w{j}" for j in range(length)) for k in range(50)]
    docs = []
    for n in range(500):
        w = items[n % 50].split()
        for _ in range(decontaminate.max_edits(length) + (n % 5 == 0)):
            kind, at = rng.randrange(3), rng.randrange(len(w)) if w else 0
            w[at : at + (kind > 0)] = [] if kind == 1 else ["edit"]
        docs.append(f"{sentence(n, 12)} {' '.join(w)} {sentence(n + 900, 12)}")
    got = {(r, i): e for r, i, e in decontaminate.Items(list(enumerate(items))).find(pa.array(docs))}
    want = {(r, i): e for r, i, _, e in brute.leaks(list(enumerate(docs)), list(enumerate(items)))}
    assert want and set(got.items()) <= set(want.items()) and len(got) >= 0.99 * len(want), len(got) / len(want)


def test_least_distance():
    rng = random.Random(2)
    for _ in range(200):
        p = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        t = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        assert decontaminate.least_distance(p, t) == brute.edit_distance_in(p, t)


def test_language_id(spark, sf, nasty, nothing):
    d = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out AND lang_pred = lang").count() >= 0.97 * got.where("held_out").count()
    assert langid.identify(d).where("score < 0 OR score > 1").count() == 0
    out = {r.doc_id: r for r in langid.identify(nasty).collect()}
    assert out[4].lang_pred == out[5].lang_pred == out[15].lang_pred == "und" and out[1].lang_pred in ("en", "de")
    assert langid.identify(nothing).collect() == []
    kept = langid.keep_identified(nasty)
    assert kept.columns == nasty.columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 15})


def test_forward_sums_all_segmentations():
    pieces = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
    p = np.array([[0.01], [0.3], [0.2], [0.25], [0.1], [0.05]])

    def total(w):
        if not w:
            return 1.0
        return sum(p[pieces[w[:k]], 0] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    index = langid.PieceIndex(pieces)
    for w in ("a", "ab", "abab", "babaab"):
        ids = index.lattice([w])
        assert langid.forward(ids, p)[0, -1, 0] == pytest.approx(total(w))
        a, s = langid._scaled(ids, p)
        assert (a * np.exp(s))[0, -1, 0] == pytest.approx(total(w))
        b, s = langid._scaled(ids, p, back=True)
        assert (b * np.exp(s))[0, 0, 0] == pytest.approx(total(w))


def test_long_words_are_scored_whole(monkeypatch):
    pieces = {s: i + 1 for i, s in enumerate(["a", "b", "ab", "ba", "aba", "\u2581a", "bbbbbbbbbbbbbbbbbb"])}
    index = langid.PieceIndex(pieces)
    p = np.random.default_rng(4).random((index.size, 2)) / 10
    word = "\u2581" + "".join(random.Random(1).choice("ab") for _ in range(60)) + "b" * 20
    ids = index.lattice([word])
    found = {(j, m + 1): i for _, j, m in zip(*np.nonzero(ids >= 0), strict=True) for i in [int(ids[0, j, m])]}
    assert found == {(j, m): pieces.get(word[j - m + 1 : j + 1], 0) for j in range(len(word)) for m in range(1, min(j + 1, 18) + 1) if m == 1 or word[j - m + 1 : j + 1] in pieces}
    want, use = langid.log_likelihood(ids, p), np.zeros_like(p)
    langid.expected(ids, p, np.ones((1, 2)), use)
    monkeypatch.setattr(langid, "LONG", 1000)
    plain = np.zeros_like(p)
    langid.expected(ids, p, np.ones((1, 2)), plain)
    assert np.allclose(want, langid.log_likelihood(ids, p)) and np.allclose(use, plain)
    # the letters covered by the expected uses are those of the word
    lengths = np.array([1, *map(len, pieces)])
    assert np.allclose((use * lengths[:, None]).sum(axis=0), len(word))
    long = index.lattice(["a" * 30_000])
    monkeypatch.setattr(langid, "LONG", 24)
    assert np.isfinite(langid.log_likelihood(long, p)).all() and (langid.log_likelihood(long, p) < -10_000).all()


def test_token_counts(spark, nasty, nothing):
    enc = tokencount.load_encoder(tokencount.VOCABULARY)
    n = sorted(len(enc.encode_ordinary(t)) if t else 0 for _, t in pairs(nasty))
    for r in tokencount.token_counts(nasty).collect():
        limit = r.n_tokens
        assert r.n_docs == n.count(limit) and r.docs_at_least == sum(x >= limit for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= limit) and r.truncated_tokens == sum(min(x, limit) for x in n)
        assert r.total_docs == len(n) and r.total_tokens == sum(n) and r.quantile == pytest.approx(sum(x <= limit for x in n) / len(n))
    assert tokencount.token_counts(nothing).collect() == []
    h = tokencount.length_histogram(nasty)
    for r in tokencount.at_limits(h, [0, 1, 7, 2048, 10**9]).collect():
        assert r.docs_at_least == sum(x >= r.limit for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.limit)
        assert r.truncated_tokens == sum(min(x, r.limit) for x in n) and r.quantile == pytest.approx(sum(x <= r.limit for x in n) / len(n))
    assert {r.share: r.n_tokens for r in tokencount.quantiles(h, [0.0, 0.5, 0.9, 1.0]).collect()} == {p: min(x for x in n if sum(y <= x for y in n) / len(n) >= p) for p in (0.0, 0.5, 0.9, 1.0)}
    none = tokencount.length_histogram(nothing)
    assert [r.total_docs for r in tokencount.at_limits(none, [5]).collect()] == [0] and [r.n_tokens for r in tokencount.quantiles(none, [0.5]).collect()] == [None]


def test_top_k(spark):
    nan = float("nan")
    data = [(0, [0.5, -0.5, 0.1], 1), (50, [0.1, 0.2, 0.3], 1), (50, [0.1, 0.2, 0.3], 2), (3, [0.5, -0.5, 0.1], 0), (2, [0.5, -0.5, 0.1], 0), (4, None, 0), (5, [1.0, nan, 1.0], 0), (6, [1.0, None], 0), (7, [9.0], 0), (8, [], 0), (None, [1.0, 1.0, 1.0], 0)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v).collect()}
    assert got[0, 1] == (7, 128 * 2304) and got[0, 2][0] == 2 and got[0, 3][0] == 3 and got[0, 4] == (8, 0)
    assert (50, 5) in got and all(q != i for (q, _), (i, _) in got.items())
    assert topk.top_k(v.where("false")).collect() == []


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    q = np.floor(256 * x).astype(int)
    want = []
    for i in range(0, 400, 50):
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        want += [(i, k + 1, j, int(q[i] @ q[j])) for k, j in enumerate(order)]
    assert sorted(tuple(r) for r in topk.top_k(v).collect()) == want


def test_mixing(spark, sf, nasty, nothing):
    d = table(spark, sf.replace("0.001", "0.01"), "documents")
    a = rows(mixing.mix_report(d))
    assert a == rows(mixing.mix_report(d.repartition(5)))
    n = mixing.mix_report(nasty).collect()
    assert len(n) == nasty.count() and next(r for r in n if r.doc_id == 4)["size"] == 0
    assert mixing.mix_documents(nasty).dtypes == nasty.dtypes
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixing.mix_documents(nasty).collect())
    assert words == sum(r.taken for r in n)
    assert mixing.mix_report(nothing).collect() == [] and mixing.mix_documents(nothing).collect() == []


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_mixing_by_source(spark, sf, scale):
    """Words of every source within 1 % of its target, or half of its smallest documents if it has few."""
    d = table(spark, sf.replace("0.001", scale), "documents")
    by = {}
    for r in mixing.mix_report(d).join(d.select("doc_id", "source"), "doc_id").collect():
        t = by.setdefault(r.source, [r.target, 0, r.source_size, []])
        t[1] += r.taken
        t[3].append(r["size"])
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(t[0] for t in by.values()) == pytest.approx(sum(t[2] for t in by.values()))
    for source, (target, taken, size, sizes) in by.items():
        assert taken == pytest.approx(target, rel=0.01, abs=sorted(sizes)[len(sizes) // 10]), source


def test_mixing_is_unbiased(spark):
    """Over many like sources every document is taken as often as the share asks, and the words hardly vary."""
    sizes = [3, 300, 40, 40, 41, 77, 500, 12, 60, 5, 33, 21, 350, 8, 19, 80]
    data = [(100 * k + i, "w " * s, f"s{k:03}") for k in range(400) for i, s in enumerate(sizes)]
    got = mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(1, 3)).collect()
    half = [r for r in got if r.target < r.source_size]
    assert len(half) == 200 * len(sizes) and half[0].target == sum(sizes) / 2
    by_doc, by_source = Counter(), Counter()
    for r in half:
        by_doc[r.doc_id % 100] += r.taken / r["size"] / 200
        by_source[r.doc_id // 100] += r.taken
    assert all(abs(x - 0.5) < 0.13 for x in by_doc.values()) and max(abs(x - sum(sizes) / 2) for x in by_source.values()) <= 5


def test_mixing_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    data = [(1, sentence(1, 9), "a", i) for i in range(50)] + [(2, None, "a", 0)] * 20 + [(3 + i, sentence(i, 5 + i), "ab"[i % 2], 1) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, copies int").repartition(3)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(data)
    mine = [r.taken // 9 for r in got if r.doc_id == 1]
    assert len(mine) == 50 and max(mine) - min(mine) <= 1
    share = got[0].target / got[0].source_size
    assert abs(sum(mine) - 50 * next(r.target / r.source_size for r in got if r.doc_id == 1)) < 1 and share
    docs = mixing.mix_documents(df)
    assert docs.dtypes == df.dtypes
    assert sum(len((r.text or "").split()) for r in docs.collect()) == sum(r.taken for r in got)


def test_mixing_of_a_document_larger_than_the_rest(spark):
    data = [(1, "w " * 5000, "a"), *[(2 + i, "w " * 10, "a") for i in range(100)], *[(200 + i, "w " * 100, "b") for i in range(100)]]
    got = mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    a = [r for r in got if r.source_size == 6000]
    # 5,333 words of 6,000: without the large one at most 1,000, so it is taken for sure
    assert a[0].target == pytest.approx(16000 / 3) and next(r.taken for r in a if r.doc_id == 1) == 5000
    assert sum(r.taken for r in a) == pytest.approx(a[0].target, abs=10)


def test_water_filling(spark):
    sizes = [("a", 5, 100), ("b", 5, 1000), ("c", 5, 10), ("d", 5, 50), (None, 1, 40)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, n_docs long, source_size long")).collect()}
    w = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    left, free = 1200.0, dict(w)
    want = {}
    while True:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * dict((x[0], x[2]) for x in sizes)[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * dict((x[0], x[2]) for x in sizes)[s]
        left = 1200 - sum(want.values())
        free = {s: v for s, v in w.items() if s not in want}
    want |= {s: left * v / sum(free.values()) for s, v in free.items()}
    assert got == pytest.approx(want)


def test_main_text():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First   para
    graph<br>with break.<p><b>Second para<p>Third &eacute;.</p><div class="share">Share me</div><ul><li>one<li>two</ul></article>
    <div id="comments"><p>A very long reader comment that says a lot about everything there is to say.</p></div><aside>Side</aside><form>Name <input></form><footer>&copy; us</footer></body></html>"""
    assert maintext.main_text(page).split("\n\n") == ["Head & line", "First para graph with break.", "Second para", "Third é.", "one", "two"]
    plain = "<body><div class='menu'><a>x</a> <a>y</a></div><div><p>" + "long text here " * 9 + "</p><p>" + "more of the text " * 9 + "</p></div><div class='ad'>buy</div></body>"
    assert maintext.main_text(plain) == ("long text here " * 9).strip() + "\n\n" + ("more of the text " * 9).strip()
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<p>") == ""
    assert maintext.main_text("just words") == "just words"


def prose(seed, n=25):
    return " ".join(sentence(seed, n).split())


def test_main_text_keeps_all_content():
    a, b, c, d = (prose(i) for i in range(4))
    both = f"<body><div class=menu><a>x</a> <a>y</a></div><div id=page><div><h1>T</h1><p>{a}</p></div><div><p>{b}</p><p>{c}</p><p>{d}</p><p>{a}</p><p>{b}</p></div></div><div class=ad>buy</div></body>"
    assert maintext.main_text(both) == "\n\n".join(["T", a, b, c, d, a, b])
    low = "<ul class=menu>" + "<li><a href=x>x</a>" * 8 + "</ul>"
    cards = f"<body>{low}<div><p>{a}</p><p>{b}</p><p>{c}</p></div><article><p>{d}</p></article><article><p>{a}</p></article>{low}</body>"
    assert maintext.main_text(cards) == "\n\n".join([a, b, c, d, a])
    split = f"<body><div><article><p>{a}</p></article><article><p>{b}</p><p>{c}</p></article></div><footer>f</footer></body>"
    assert maintext.main_text(split) == "\n\n".join([a, b, c])


def test_main_text_furniture_words_in_articles():
    a, b, c, d = (prose(i) for i in range(4))
    for section in ("<section id='discussion'>", "<section id='related-work'>", "<section id='search'>", "<section class='comments-on-method'>", "<div id='discussion'>"):
        page = f"<body><article><p>{a}</p>{section}<h2 id='sharing-comments'>Head</h2><p>{b}</p><p>{c}</p></section></div></article></body>"
        assert maintext.main_text(page) == "\n\n".join([a, "Head", b, c]), section
    for wrapper in ("container has-sidebar", "no-sidebar", "page sidebar", "menu"):
        for tag in ("article", "div"):
            page = f"<body><div class='{wrapper}'><{tag}><p>{a}</p><p>{b}</p></{tag}><div class='sidebar'><p>{c}</p></div></div></body>"
            assert maintext.main_text(page) == a + "\n\n" + b, (wrapper, tag)
    page = f"<body><article><p>{a}</p><p>{b}</p></article><div id='comments'><article class='comment'><p>{prose(8, 20)}</p></article></div></body>"
    assert maintext.main_text(page) == a + "\n\n" + b


def test_main_text_hidden_inside_blocks():
    a, b = prose(1), prose(2)
    for inner in ("<script>var x = 1;</script>", "<button>press</button>", "<svg><text>s</text></svg>", "<noscript>n</noscript>", "<span hidden>SECRET</span>", "<span class='ad'>SECRET</span>", "<i style='display: none'>SECRET</i>", "<!-- c -->"):
        assert maintext.main_text(f"<body><article><p>BEFORE {inner} AFTER {a}</p><p>{b}</p></article></body>") == f"BEFORE AFTER {a}\n\n{b}", inner
    for name in ("market-share", "notice-of-change", "research-group", "adelaide", "commentary"):
        assert maintext.main_text(f"<body><article><p>{a}</p><div class='{name}'><p>{b}</p></div></article></body>") == f"{a}\n\n{b}", name
    for name in ("cookie-notice", "post-comments", "share-buttons", "sidebar left", "ad_container"):
        assert maintext.main_text(f"<body><article><p>{a}</p><div class='{name}'>x y z</div><p>{b}</p></article></body>") == f"{a}\n\n{b}", name


def test_main_text_regions():
    a, b, c, d = (prose(i) for i in range(4))
    short = f"<body><article><h2>Part</h2><p>{a}</p><p>{b}</p></article><article><p>Short.</p></article></body>"
    assert maintext.main_text(short).split("\n\n") == ["Part", a, b, "Short."]
    form = f"<body><form id=f><nav><a href=x>x</a></nav><article><p>{a}</p><p>{b}</p><form>Name</form></article></form></body>"
    assert maintext.main_text(form).split("\n\n") == [a, b]
    reader = f"<body><main><article><p>{a}</p><p>{b}</p></article><section class='comments'><article><p>{c}</p></article></section></main></body>"
    assert maintext.main_text(reader).split("\n\n") == [a, b]
    links = "".join(f"<li><a href=x>go to {i}</a></li>" for i in range(6))
    plain = f"<body><div class=x1><ul>{links}</ul></div><h1>Title</h1><div class=x2><p>{a}</p><p>{b}</p><ul>{links}</ul><p>To.</p><p>{c}</p></div><div class=x3>Copyright</div></body>"
    assert maintext.main_text(plain).split("\n\n") == ["Title", a, b, "To.", c]


def test_main_text_of_long_and_deep_pages():
    a = prose(1)
    deep = "<div>" * 50_000 + f"<p>{a}</p>" + "</span>" * 50_000
    assert maintext.main_text(deep) == a
    many = "<article>" + f"<p>{a}</p>" * 20_000 + "</article>"
    assert maintext.main_text(many) == "\n\n".join([a] * 20_000)


def test_main_text_of_the_pages(spark, sf):
    """Against a plain extractor for the one form that these pages have."""
    got = {r.page_id: (r.text, r.n_chars) for r in maintext.extract(table(spark, sf, "pages")).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body.replace("<b>", "").replace("<br>", " "))]
        want = "\n\n".join(x for x in blocks if x)
        assert got[r.page_id] == (want, len(want))


def test_main_text_table(spark):
    p = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article>é</article>", "x"), (None, "u", "", "y")], "page_id long, url string, html string, text string")
    got = rows(maintext.extract(p))
    assert got == [(1, "u", "é", 1), (1, None, "", 0), (None, "u", "", 0)]
    assert maintext.extract(p.where("false")).collect() == []


def test_licenses(spark, nasty, nothing):
    mit = licenses.LICENSES["MIT"]
    data = [(1, "Copyright (c) 2020 A\n\n" + mit.upper()), (2, mit + " extra"), (3, None), (4, " .,! "), (5, mit.replace("license", "licence").replace(" ", "\n")), (6, "© 1999\n(C) 2001 B\nreleased under the MIT licence")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].license_id == got[5].license_id == "MIT" and got[2].license_id is None and got[6].license_id == "MIT-line"
    assert got[3].digest is None and got[4].digest is None
    assert licenses.scan(nasty).count() == nasty.count() and licenses.scan(nothing).collect() == []


def test_licenses_with_ordinary_notices(spark):
    heads = "Copyright (c) Microsoft Corporation.|Copyright The Foo Authors|Copyright (c) [year] [name]|Copyright Jane Doe 2020|© Jane Doe|(c) Jane Doe 2020|Copyright: Foo Ltd|Copyright (c) 2020 A\nAll rights reserved.".split("|")
    texts = licenses.LICENSES | licenses.MORE_LICENSES
    cases = [(h + "\n\n" + t, k) for k, t in texts.items() for h in heads]
    # no wrapping of a licence may look like a notice
    cases += [("Copyright The Foo Authors\n\n" + textwrap.fill(" ".join(t.split()), n, break_long_words=False, break_on_hyphens=False), k) for k, t in texts.items() if "[yyyy]" not in t and "Hocevar" not in t for n in range(30, 110)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df).collect()}
    assert [(cases[i][1], cases[i][0][:300]) for i in got if got[i] != cases[i][1]] == []


def test_licenses_equal_duckdb(spark):
    import duckdb

    mit = licenses.LICENSES["MIT"]
    heads = "Copyright (c) Foo|copyright holders|Copyright: Foo|(c) 2020 A|(c) the first of 3|x (c) A 2021.|© Foo|All rights reserved.|* Copyright 1999|Copyrights 1999|copyright|a copyright 2020|COPYRIGHT, the".split("|")
    data = [(i, f"{h}\n{mit}") for i, h in enumerate(heads)] + [(100 + i, h) for i, h in enumerate(heads)]
    data += [(200, "licence licence licence licence"), (201, ""), (202, None), (203, "Noncommercial organisation's\tlicences"), (204, licenses.MORE_LICENSES["Unlicense"]), (205, "ünï © é\r\n" + mit)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert rows(licenses.scan(df).select("doc_id", "digest", "license_id")) == sorted(con.sql(licenses.oracle()).fetchall(), key=str)
    assert {r.doc_id for r in licenses.scan(df).where("license_id = 'MIT'").collect()} == {0, 2, 3, 6, 7, 8}


def test_license_notices(spark, sf, nasty, nothing):
    mit, head = licenses.LICENSES["MIT"], licenses.LICENSES["Apache-2.0-header"]
    line = "Licensed under CC BY-NC 4.0."
    data = [(1, f"some words\n{line}\nmore words"), (2, "a\n\n" + mit.replace("\n\n", "\n\nCopyright (c) Foo\n\n") + "\n\nb"), (3, f"x {head} {head} y"), (4, f"Copyright 2020 A. {line}"), (5, "Licensed under CC BY"), (None, line), (None, line), (6, None)]
    got = rows(licenses.notices(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == sorted([(1, "CC-BY-NC-4.0-line"), (2, "MIT"), (3, "Apache-2.0-header"), (4, "CC-BY-NC-4.0-line"), (None, "CC-BY-NC-4.0-line"), (None, "CC-BY-NC-4.0-line")], key=str)
    assert licenses.notices(nothing).collect() == []
    docs = table(spark, sf, "documents")
    known = {" ".join(re.findall(r"[^\W_]+", v.lower())): k for k, v in licenses.LICENSES.items()}
    want = {(r.doc_id, known[f]) for r in docs.collect() for x in (r.text or "").split("\n") if (f := " ".join(re.findall(r"[^\W_]+", x.lower()))) in known}
    assert want and want <= {tuple(r) for r in licenses.notices(docs).collect()}


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries()} == set(range(1, 11)) and set(oracle_sql()) <= set(queries())


def plain_sanitised(text):
    """Base spans by the plain patterns, the first of overlapping ones naming the whole."""
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute.pii(text)[5].split(",") if x))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline(spark, sf):
    """Every stage against plain Python on what it was given, and the whole against its stages."""
    import corpus_pipeline
    from tessera.session import materialise

    d = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    stages, docs, seen = dict(corpus_pipeline.STAGES), d, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.dtypes == d.dtypes
        seen[name] = sorted(pairs(docs))
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "personal_data", "source_mixing"]
    given = [(i, t) for i, t in pairs(d) if any(c.isalpha() for c in t or "")]
    assert seen["language_id"] == sorted(given)
    groups = {c for _, _, c, _ in brute.near(given)}
    kept = [(i, t) for i, t in given if i in groups]
    assert seen["near_duplicates"] == sorted(kept)
    leaking = {r[0] for r in brute.leaks(kept, items)}
    kept = [(i, t) for i, t in kept if i not in leaking]
    assert leaking and seen["decontamination"] == sorted(kept)
    clean = {i: plain_sanitised(t) for i, t in kept}
    assert seen["personal_data"] == sorted(clean.items())
    copies = Counter(i for i, _ in seen["source_mixing"])
    assert set(seen["source_mixing"]) <= set(clean.items()) and max(copies.values()) <= 3
    assert sorted(pairs(corpus_pipeline.run(spark, sf))) == seen["source_mixing"]


def test_pipeline_on_nasty_and_empty_tables(spark, sf, nasty, nothing, tmp_path):
    import corpus_pipeline

    for name, df in (("nasty", nasty), ("nothing", nothing)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        table(spark, sf, "benchmark").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.dtypes == df.dtypes
        got = Counter(r.doc_id for r in out.collect())
        assert not set(got) & {2, 3, 4, 5, 6, 8, 15} and (got or name == "nothing") and max(got.values(), default=0) <= 3


@pytest.mark.parametrize("in_one_task", [0, 100_000])
def test_components(spark, monkeypatch, in_one_task):
    from tessera.llm import components as cc

    monkeypatch.setattr(cc, "IN_ONE_TASK", in_one_task)
    rng = random.Random(6)
    name = lambda i: i.to_bytes(2, "big")
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = {(bytes(r.node), bytes(r.root)) for r in cc.components(df).collect()}
    assert got == {(name(x), name(find(x))) for x in root if find(x) != x}
    assert cc.components(df.where("false")).collect() == []
    chain = spark.createDataFrame([(name(i), name(i // 2)) for i in range(1, 60)], "node binary, parent binary")
    assert {(bytes(r.node), bytes(r.root)) for r in cc.forest_roots(chain).collect()} == {(name(i), name(0)) for i in range(1, 60)}
