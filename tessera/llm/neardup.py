"""Near-duplicates by SuperMinHash (operator 10).

Every document's set of 5-word shingles gets a SuperMinHash signature: each
element offers one value to each place in the order of its own random
permutation, and the permutations are followed only until no place can change
any more. Signatures are banded; documents that share a band are candidates,
confirmed on their full shingle sets; union-find over the confirmed links gives
the groups.

Equal sets are one class from the start, so copies never meet as pairs. A class
most of whose signature no other class has can't have a link: keys of two places
tell, of which a linked class shares 36 of 64 on average and fewer than 17 with
probability 1e-6. Of the rest, those that share a band are candidates. First
each meets one of them, the one whose signature is the most shared (the centre of
its family). Then every class meets all those of its buckets that are not in its
component yet, if their sets can reach the threshold: of a set only shingles that
another class has can be common, and these are counted exactly; and a longer
sketch of the few classes left must not differ by more than a link's does. (While that is
too many pairs, members of divided buckets meet further hubs.) So no link can be
missed for being in a large bucket, and within a component no further pairs are
made. With 32 bands of 4 a link at the threshold shares no band with probability
5e-6.

Nulls, ties and clashes: a null text, or one without words, has an empty set, is
its own component and is kept; a null doc_id is never the smallest while another
doc_id is there (a group of nulls has a null component_id and counts as kept);
repeated rows are in one class and come back each; extra columns are ignored by
``groups`` and kept by ``drop_near_duplicates``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import forest_roots, merged
from tessera.llm.textblocks import Words, mix, shingles, text_blocks
from tessera.session import materialise, release, scratch, setting, small_batches

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
PLACES, BANDS = 128, 32
#: Keys of a signature, each of two places, and how many of them a link shares at least (see above).
KEYS, LEAST_KEYS = 64, 17
#: Bits of a longer sketch, one a place, for pairs across components; of a link's at the threshold 128 differ on average, more than this with probability 1e-6.
SKETCH, DIFFERENT = 1024, 181
#: Cross-component pairs per class beyond which another round of hubs comes before the pairs.
PAIRS_PER_CLASS = 20
MOST_ROUNDS = 2


def super_minhash(row: np.ndarray, value: np.ndarray, n_rows: int, places: int = PLACES) -> np.ndarray:
    """Signatures (row, place) of the sets given as (row, element hash); rows without elements stay infinite."""
    sig = np.full(n_rows * places, np.inf)
    live = np.arange(len(row))
    jumps: list[np.ndarray] = []
    order = None
    for j in range(places):
        if not len(live):
            break
        seed = mix(value[live] + np.uint64(0x632BE59BD9B4E019) * np.uint64(j + 1))
        real = (seed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        k = j + (mix(seed) % np.uint64(places - j)).astype(np.int64)
        if j == 0:
            at = k
            jumps = [k]
        elif j == 1:
            # after the first exchange place k holds k, or 0 if it was the one exchanged
            at = np.where(k == jumps[0], 0, k)
            jumps.append(k)
        else:
            n = np.arange(len(live))
            if order is None:
                order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int16), (len(live), 1))
                for i, q in enumerate(jumps):
                    held = order[n, q].copy()
                    order[n, q] = order[:, i]
                    order[:, i] = held
            held = order[n, k].copy()
            order[n, k] = order[:, j]
            order[:, j] = held
            at = held.astype(np.int64)
        np.minimum.at(sig, row[live] * places + at, real + j)
        # a row is done when all its places hold less than anything still to come
        open_rows = sig.reshape(n_rows, places).max(axis=1) >= j + 1
        stay = open_rows[row[live]]
        live = live[stay]
        if order is not None:
            order = order[stay]
        else:
            jumps = [q[stay] for q in jumps]
    return sig.reshape(n_rows, places)


def place_keys(sig: np.ndarray, bands: int = KEYS) -> np.ndarray:
    """One key per row and run of places; the run's number is part of it."""
    n, places = sig.shape
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(n, bands, places // bands)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), (n, bands)).copy()
    for i in range(places // bands):
        acc = mix(acc + bits[:, :, i])
    return acc.view(np.int64)


def _sets(column, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each shingle, shingle) by blocks."""
    for first, data, offs, _ in text_blocks(column, limit):
        row, value = shingles(Words(data, offs), WIDTH)
        yield first, len(offs) - 1, row, value


def _digests(n: int, row: np.ndarray, value: np.ndarray) -> list[bytes | None]:
    ends = np.searchsorted(row, np.arange(n + 1))
    raw = value.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, keys) of ``docs`` (doc_id, text); digest names the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, value in _sets(batch.column(2)):
                keys = place_keys(super_minhash(row, value, n))
                digests = _digests(n, row, value)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * KEYS)
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    ["doc_id", "text_hash", "n_shingles", "digest", "keys"],
                )

    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, text): a text of each class in ``wanted`` (digest, doc_id, text_hash)."""
    w = wanted.select("digest", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return d.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("digest", "text")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets are similar enough."""
    ta = texts.select(F.col("digest").alias("da"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("digest").alias("db"), F.col("text").alias("text_b"))
    both = pairs.join(ta, F.col("a") == F.col("da")).drop("da").join(tb, F.col("b") == F.col("db")).drop("db")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for first, n, row_a, set_a in _sets(batch.column("text_a")):
                _, _, row_b, set_b = next(_sets(batch.column("text_b").slice(first, n), 1 << 62))
                row, value = np.concatenate([row_a, row_b]), np.concatenate([set_a, set_b])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(row[1:][same], minlength=n)
                union = np.bincount(row, minlength=n) - common
                good[first : first + n] = 100 * common >= PERCENT * union
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    # texts of repeated rows stand more than once
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary").distinct()


def _may_link(n: str, m: str) -> F.Column:
    """Sets of these sizes can reach the threshold at all."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _bands(keys: str) -> F.Column:
    """Bucket names of the bands, each from the keys of its places."""
    per = KEYS // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(keys, b * per + 1, F.lit(per))))


def likely(classes: DataFrame) -> DataFrame:
    """The ``classes`` (digest, keys, ...) enough of whose keys others have, and how many (``centre``); by counts, so large groups cost what small ones do."""
    keyed = classes.select(F.xxhash64("digest").alias("c"), F.explode("keys").alias("key"))
    with scratch() as keep:
        common = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "n"), "common")
        # equal 64-bit names of two classes would only keep both
        strong = keyed.join(common, F.col("key") == F.col("k")).groupBy("c").agg(F.count("*").alias("shares"), F.sum("n").alias("centre")).where(F.col("shares") >= LEAST_KEYS)
        strong = keep(strong.select(F.col("c").alias("s"), "centre"), "strong")
        return materialise(classes.join(strong, F.xxhash64("digest") == F.col("s")).drop("s"), "live")


def common_shingles(texts: DataFrame) -> DataFrame:
    """(c, common): of each class of ``texts`` (digest, text), by hash, the shingles that another of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            for first, _, row, value in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(c[first + row]), pa.array(value.view(np.int64))], ["c", "sh"])

    # a class may stand more than once in ``texts``, if its row is repeated
    once = texts.groupBy(F.xxhash64("digest").alias("c")).agg(F.first("text").alias("text"))
    with scratch() as keep:
        each = keep(once.mapInArrow(run, "c long, sh long"), "shingles")
        some = keep(each.groupBy("sh").agg(F.count("*").alias("n")).where("n > 1").select(F.col("sh").alias("s")), "some")
        counted = each.join(some, F.col("sh") == F.col("s"), "left_semi").groupBy("c").agg(F.count("*").alias("common"))
        return materialise(counted.withColumnRenamed("c", "cc"), "counts")


def class_roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the ``classes`` that are not the root of their component of the similarity graph."""
    with scratch() as keep:
        live = likely(classes)
        # the largest shuffle, of all texts, while little else is written
        texts = keep(_texts(docs, live), "texts")
        rows = live.select(F.posexplode(_bands("keys")).alias("band", "bucket"), "digest", "n", "centre")
        hubs = rows.groupBy("bucket").agg(F.max(F.struct("centre", "digest")).alias("hub"), F.count("*").alias("members")).where("members > 1")
        hubs = materialise(hubs.select(F.col("bucket").alias("k"), "hub"), "hubs")
        shared = materialise(rows.join(hubs, F.col("bucket") == F.col("k")).select("bucket", "band", "digest", "n", "hub"), "buckets")
        release(hubs)
        # hubs come later in the order of (centre, digest) than their members: a forest
        first = shared.where("digest <> hub.digest").groupBy("digest").agg(F.max("hub").alias("hub"))
        tested = keep(first.select(F.col("digest").alias("a"), F.col("hub.digest").alias("b")), "pairs")
        links = confirm(tested, texts)
        roots = forest_roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent")))
        slim = materialise(shared.drop("hub"), "buckets")
        release(shared)
        shared = slim
        named = _named(shared, roots)
        several = _split(named).limit(1).count()
        release(named)
        if not several:
            release(live, shared)
            return roots
        counts = keep(common_shingles(texts), "counts")
        can = shared.join(counts, F.xxhash64("digest") == F.col("cc")).where(100 * F.col("common") >= PERCENT * F.col("n"))
        able = keep(can.select("bucket", "band", "digest", "n", "common"), "buckets")
        release(shared)
        shared = able
        # 32 bits of every bucket's name; a pair is made in the first bucket it shares only
        marks = keep(live.select(F.col("digest").alias("md"), F.transform(_bands("keys"), lambda b: F.hash(b)).alias("marks")), "marks")
        n_classes = live.count()
        release(live)
        left = shared.select(F.col("digest").alias("x")).distinct()
        bits = keep(sketches(texts.join(left, F.col("digest") == F.col("x"), "left_semi")), "sketches")
        for turn in range(MOST_ROUNDS + 1):
            fresh, last = _across(shared, roots, marks, bits, tested, turn, n_classes)
            if fresh is None:
                break
            roots = merged(roots, confirm(keep(fresh, "pairs"), texts))
            tested = tested.unionByName(fresh)
            if last:
                break
        return roots


def _across(shared: DataFrame, roots: DataFrame, marks: DataFrame, bits: DataFrame, tested: DataFrame, turn: int, n_classes: int) -> tuple[DataFrame | None, bool]:
    """Pairs (a, b) not yet ``tested`` of classes in one bucket and in different components, and whether these are all; None if there is no such bucket."""
    names = [c for c in bits.columns if c != "sd"]
    with scratch() as keep:
        named = keep(_named(shared, roots), "named")
        split = keep(_split(named), "split")
        cost = split.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
        if not cost:
            return None, True
        open_rows = named.join(split.select("k", "big"), F.col("bucket") == F.col("k")).drop("k")
        open_rows = open_rows.join(marks, F.col("digest") == F.col("md")).join(bits, F.col("digest") == F.col("sd")).drop("md", "sd")
        open_rows = keep(open_rows, "open")
        last = turn == MOST_ROUNDS or cost <= PAIRS_PER_CLASS * n_classes
        if last:
            side = open_rows.where("comp <> big")
        else:
            # buckets in several parts, some large: their members meet a new hub of the bucket first
            order = F.xxhash64("digest", "bucket", F.lit(turn))
            side = open_rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "digest", "n", "common", "comp", "marks", *names)).alias("h")).select("bucket", "h.*")
        side = keep(side.select(F.col("bucket").alias("k"), F.col("digest").alias("d"), F.col("n").alias("m"), F.col("common").alias("f"), F.col("comp").alias("c"), F.col("marks").alias("w"), *[F.col(c).alias(f"o{c}") for c in names]), "side")
        apart = (F.col("comp") != F.col("c")) & _may_link("n", "m")
        # what both have is at most what either has in common with any
        apart &= (100 + PERCENT) * F.least("common", "f") >= PERCENT * (F.col("n") + F.col("m"))
        apart &= reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in names]) <= DIFFERENT
        if last:
            apart &= ~F.arrays_overlap(F.slice("marks", F.lit(1), F.col("band")), F.slice("w", F.lit(1), F.col("band")))
            apart &= (F.col("comp") == F.col("big")) | (F.col("digest") > F.col("d"))
        pairs = open_rows.join(side, (F.col("bucket") == F.col("k")) & apart)
        pairs = pairs.select(F.greatest("digest", "d").alias("a"), F.least("digest", "d").alias("b")).distinct()
        done = tested.select(F.greatest("a", "b").alias("ta"), F.least("a", "b").alias("tb"))
        return materialise(pairs.join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "pairs"), last


def _named(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` with the component of each class."""
    d = shared.join(roots.select("node", "root"), F.col("digest") == F.col("node"), "left").drop("node")
    return materialise(d.withColumn("comp", F.coalesce("root", "digest")).drop("root"), "named")


def _split(named: DataFrame) -> DataFrame:
    """(k, big, cost) of the buckets in several parts: the largest part, and the pairs at most to be made."""
    parts = named.groupBy("bucket", "comp").agg(F.count("*").alias("members"))
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("members").alias("total"), F.max(F.struct("members", "comp")).alias("most")).where("parts > 1")
    return whole.select(F.col("bucket").alias("k"), F.col("most.comp").alias("big"), ((F.col("total") - F.col("most.members")) * F.col("total")).alias("cost"))


def sketches(texts: DataFrame) -> DataFrame:
    """(sd, s0, s1, ...): of each class of ``texts`` (digest, text) one bit of each place of a long signature, 64 to a column."""
    words = SKETCH // 64
    names = [f"s{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, value in _sets(batch.column(1), 1 << 16):
                sig = super_minhash(row, value, n, SKETCH)
                bits = (mix(sig.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(words)]], ["sd", *names])

    out = texts.mapInArrow(run, "sd binary, " + ", ".join(f"{c} long" for c in names))
    # the work per byte is high: partitions small in bytes aren't joined up
    with setting(texts.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m"):
        return materialise(out.groupBy("sd").agg(*[F.first(c).alias(c) for c in names]), "sketches")


def groups_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession), scratch() as keep:
        sigs = materialise(signatures(docs), "signatures")
        rows = materialise(sigs.drop("keys"), "rows")
        classes = sigs.where("digest IS NOT NULL").groupBy("digest").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "text_hash")).alias("at"), F.min("doc_id").alias("low"))
        classes = materialise(classes.select("digest", "n", "keys", "at.doc_id", "at.text_hash", "low"), "classes")
        release(sigs)
        low = keep(classes.select("digest", "low"), "low")
        roots = class_roots(docs, classes.drop("low"))
        release(classes)
        lowest = low.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "digest").alias("root"))
        lowest = keep(lowest, "lowest")
        release(roots)
        of_root = keep(lowest.groupBy("root").agg(F.min("low").alias("component")).withColumnRenamed("root", "r"), "roots")
        of_class = materialise(lowest.join(of_root, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component"), "components")
    d = rows.join(of_class, F.col("digest") == F.col("d"), "left")
    found = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return d.select("doc_id", "text_hash", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return groups_of(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; of repeated rows with the kept doc_id and text one stays."""
    kept = groups_of(docs).where("kept")
    once = materialise(kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")).withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"}), "kept")
    th = F.xxhash64(docs["text"])
    packed = docs.select(docs["doc_id"].cast("long").alias("id"), th.alias("th"), F.struct("*").alias("row"))
    stay = packed.join(once, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_hash")))
    single = stay.where("rows = 1 OR n = 0").select("row.*")
    if once.where("rows > 1 AND n > 0").limit(1).count() == 0:
        return single
    again = stay.where("rows > 1 AND n > 0").groupBy("k_id", "k_hash").agg(F.first("row").alias("row"))
    return single.unionByName(again.select("row.*"))
