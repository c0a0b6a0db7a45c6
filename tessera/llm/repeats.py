"""Removal of repeated 200-byte strings by deep-shallow suffix sorting (operator 3).

A byte goes if a 200-byte string that covers it also starts anywhere else. Only
the starts of such strings matter, and only next to strings that can equal them:

1. Every 200-byte window has an anchor, the leftmost of its smallest hashed
   ``CORE``-byte cores. Windows of consecutive starts with one anchor form a
   segment, about one for 80 bytes. Equal windows have equal anchors at equal places, so
   only segments with a common core can hold equal windows.
2. Segments whose core is nowhere else hold no repeats; segments that are equal
   as a whole (64-bit core and 64-bit digest) hold nothing but repeats.
3. What remains, the rims of shared passages, is brought together by core and
   its suffixes are sorted deep-shallow: multikey quicksort over 8-byte
   characters to ``SHALLOW`` bytes, each depth partitioning the groups still
   tied, then a blind trie for each group that still ties, built over the rest
   of the 200 bytes. Neighbours equal over all 200 bytes are repeats.

A core with more than ``CHUNK`` different segments is dealt out in chunks. Each chunk sorts
its own suffixes and hands on one row for each different window, so a passage in
a third of all documents is pre-aggregated; equal windows of different chunks
meet by digest.

Nulls, ties and clashes: a null text is an empty one; copies of a text are rows
like others (all their windows repeat); rows are told apart by doc_id and text,
and rows that agree in both, which hold the same result, come back each; a null
doc_id is an ordinary row; extra columns are ignored; an empty table gives no
rows. Texts are worked through in blocks, so their length isn't bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textblocks import prefix_hash, span_hash, text_blocks
from tessera.session import materialise, release, scratch

LENGTH = 200
#: Bytes of the hashed core; a window has LENGTH - CORE + 1 of them.
CORE = 48
#: Bytes sorted by multikey quicksort before tries take over.
SHALLOW = 48
#: Different segments of one core in a chunk, and segments in one sorting group.
CHUNK = 4096
_BLOCK = 1 << 20
_PLACE_BITS = 26


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` elements, by minima within blocks from both sides."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(left[:count], right[width - 1 : width - 1 + count])


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, core hash, first start, last start, anchor) of the segments of a block of rows; places are relative to the block."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return empty, empty.astype(np.uint64), empty, empty, empty
    prefix = prefix_hash(data)
    at = np.arange(n - CORE + 1)
    h = span_hash(prefix, at, at + CORE)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_min((h & ~low) | at.astype(np.uint64), LENGTH - CORE + 1)
    anchor = (least & low).astype(np.int64)
    # a window must lie within its row
    room = np.diff(offs)
    row = np.repeat(np.arange(len(offs) - 1), room)
    starts = len(anchor)
    ok = row[:starts] == row[LENGTH - 1 : LENGTH - 1 + starts]
    valid = np.flatnonzero(ok)
    if not len(valid):
        return empty, empty.astype(np.uint64), empty, empty, empty
    a = anchor[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return row[valid[first]], h[a[first]], valid[first], valid[last], a[first]


def row_blocks(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row number, place in its text) of stretches: whole short texts together, long ones in overlapping stretches."""
    for first, data, offs, _ in text_blocks(column, _BLOCK):
        if len(data) <= 2 * _BLOCK:
            yield data, offs, np.arange(first, first + len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
            continue
        for r in range(len(offs) - 1):
            text = data[offs[r] : offs[r + 1]]
            for lo in range(0, len(text), _BLOCK):
                part = text[lo : lo + _BLOCK + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([first + r]), np.array([lo])


def find_segments(docs: DataFrame) -> DataFrame:
    """(k1, k2, core, body, s0, s1, p): row key, core hash, digest of the segment's bytes, first and last start, anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, offs, rows, place in row_blocks(batch.column(2)):
                row, core, s0, s1, p = segments(data, offs)
                if not len(row):
                    continue
                raw = data.tobytes()
                digest = b"".join([hashlib.blake2b(raw[a : b + LENGTH], digest_size=8).digest() for a, b in zip(s0.tolist(), s1.tolist(), strict=True)])
                shift = place[row] - offs[row]
                cols = [k1[rows[row]], k2[rows[row]], core.view(np.int64), np.frombuffer(digest, np.int64), s0 + shift, s1 + shift, p + shift]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "core", "body", "s0", "s1", "p"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, core long, body long, s0 long, s1 long, p long")


class BlindTrie:
    """A binary trie over equally long bit strings that keeps only the branching bits, not the bits between."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.root = None

    def insert(self, key: int, item: int) -> None:
        """Go down by the branching bits alone, compare with the leaf reached, and branch off at the first difference."""
        if self.root is None:
            self.root = [-1, key, [item]]
            return
        node, shift = self.root, self.bits - 1
        while node[0] >= 0:
            node = node[2] if (key >> (shift - node[0])) & 1 else node[1]
        differ = key ^ node[1]
        if not differ:
            node[2].append(item)
            return
        bit = self.bits - differ.bit_length()
        parent, node = None, self.root
        while 0 <= node[0] < bit:
            parent, side = node, 1 + ((key >> (shift - node[0])) & 1)
            node = node[side]
        leaf = [-1, key, [item]]
        branch = [bit, node, leaf] if (key >> (shift - bit)) & 1 else [bit, leaf, node]
        if parent is None:
            self.root = branch
        else:
            parent[side] = branch

    def in_order(self) -> Iterator[list[int]]:
        """Items of equal keys together, keys in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[2], node[1]]


def deep_shallow(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the 200-byte strings at ``starts``, and for each place in it the number of its class of equal strings."""
    buf = np.frombuffer(data + bytes(8), np.uint8)
    n = len(buf) - 7
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | buf[i : n + i]
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))  # places in order that still belong to a larger group
    for depth in range(0, SHALLOW, 8):
        if not len(tied):
            break
        w = word[starts[order[tied]] + depth]
        by = np.lexsort((w, group[tied]))
        moved = order[tied][by]
        order[tied] = moved
        g, w = group[tied][by], w[by]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        # a group is named after its first place
        named = tied[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        group[tied] = named
        size = np.bincount(np.cumsum(new) - 1)
        tied = tied[np.repeat(size > 1, size)]
    cls = group.copy()
    if len(tied):
        edges = np.flatnonzero(np.diff(group[tied], prepend=-1))
        bits = 8 * (LENGTH - SHALLOW)
        for a, b in zip(edges, np.append(edges[1:], len(tied)), strict=True):
            places = tied[a:b]
            items = order[places].tolist()
            trie = BlindTrie(bits)
            for item in items:
                s = int(starts[item])
                trie.insert(int.from_bytes(data[s + SHALLOW : s + LENGTH], "big"), item)
            at = int(places[0])
            for same in trie.in_order():
                order[at : at + len(same)] = same
                cls[at : at + len(same)] = at
                at += len(same)
    return order, cls


def sort_group(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a group of segments; returns spans of repeats, and windows to be met again for chunked cores.

    kind 0: [a, b) of a row is covered by repeats. kind 1: a window of a chunked
    core, with its digest, how often the chunk has it, and its place if it is still undecided.
    """
    bodies = table.column("bytes").to_pylist()
    k1, k2, s0, n, chunked = (table.column(c).to_numpy() for c in ("k1", "k2", "s0", "n", "chunked"))
    sizes = np.array([len(b) for b in bodies])
    base = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    seg = np.repeat(np.arange(len(bodies)), count)
    local = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    data = b"".join(bodies)
    order, cls = deep_shallow(data, base[seg] + local)
    # how often each class occurs, segments that stand for several counting as often
    times = np.bincount(cls, weights=n[seg[order]], minlength=len(order)).astype(np.int64)[cls]
    repeat = np.zeros(len(order), bool)
    repeat[order] = times > 1
    out = {c: [] for c in ("kind", "k1", "k2", "a", "b", "h1", "h2", "n")}

    def add(kind, x1, x2, a, b, h1, h2, m) -> None:
        for c, v in zip(out, (kind, x1, x2, a, b, h1, h2, m), strict=True):
            out[c].append(np.asarray(v, np.int64))

    # segments with n > 1 are repeats as a whole already; the others get the runs of their repeated starts
    own = np.flatnonzero(repeat & (n[seg] == 1))
    if len(own):
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1] + 1) | (seg[own[1:]] != seg[own[:-1]])
        f = np.flatnonzero(new)
        last = own[np.append(f[1:], len(own)) - 1]
        f = own[f]
        z = np.zeros(len(f), np.int64)
        add(z, k1[seg[f]], k2[seg[f]], s0[seg[f]] + local[f], s0[seg[f]] + local[last] + LENGTH, z, z, z)
    heads = np.flatnonzero(cls == np.arange(len(cls)))
    heads = heads[chunked[seg[order[heads]]] > 0]
    if len(heads):
        item = order[heads]
        at = base[seg[item]] + local[item]
        digest = np.frombuffer(b"".join([hashlib.blake2b(data[s : s + LENGTH], digest_size=16).digest() for s in at.tolist()]), np.int64).reshape(-1, 2)
        open_ = times[heads] == 1
        one = np.ones(len(heads), np.int64)
        a = np.where(open_, s0[seg[item]] + local[item], -1)
        add(one, k1[seg[item]], k2[seg[item]], a, a + LENGTH, digest[:, 0], digest[:, 1], times[heads])
    return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for c, v in out.items()})


def _lists(wanted: DataFrame) -> DataFrame:
    """(w1, w2, segs): ``wanted`` (k1, k2, ...) with a row's segments as one list."""
    fields = [c for c in wanted.columns if c not in ("k1", "k2")]
    return wanted.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_list(F.struct(*fields)).alias("segs"))


def cut_out(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(k1, k2, s0, s1, ..., bytes) of each segment in ``lists`` (w1, w2, segs)."""
    fields = lists.schema["segs"].dataType.elementType.names
    both = docs.join(lists, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("k1", "k2", F.col("text").cast("binary").alias("text"), "segs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64).to_pylist()
                cols: dict[str, list] = {c: [] for c in ("k1", "k2", *fields, "bytes")}
                for r in rows:
                    for s in r["segs"]:
                        cols["k1"].append(r["k1"])
                        cols["k2"].append(r["k2"])
                        for c in fields:
                            cols[c].append(s[c])
                        cols["bytes"].append(r["text"][s["s0"] : s["s1"] + LENGTH])
                yield pa.RecordBatch.from_arrays([*[pa.array(cols[c], pa.int64()) for c in ("k1", "k2", *fields)], pa.array(cols["bytes"], pa.binary())], ["k1", "k2", *fields, "bytes"])

    return both.mapInArrow(run, "k1 long, k2 long, " + ", ".join(f"{c} long" for c in fields) + ", bytes binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(x1, x2, spans): for each row of ``docs`` (k1, k2, text) the stretches (a, b) covered by repeats; they may overlap."""
    with scratch() as keep:
        segs = materialise(find_segments(docs), "segments")
        # written on its own, so that a core in a third of all segments is joined in splits
        cores = keep(segs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select(F.col("core").alias("c")), "cores")
        shared = keep(segs.join(cores, F.col("core") == F.col("c"), "left_semi"), "shared")
        release(segs)
        bodies = shared.groupBy("core", "body").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "s0", "s1")).alias("r"))
        bodies = keep(bodies.select("core", "body", "n", "r.*"), "bodies")
        # whole segments that stand more than once
        many = keep(bodies.where("n > 1").select(F.col("core").alias("c"), F.col("body").alias("d")), "many")
        whole = shared.join(many, (F.col("core") == F.col("c")) & (F.col("body") == F.col("d")), "left_semi").select("k1", "k2", F.col("s0").alias("a"), (F.col("s1") + LENGTH).alias("b"))
        # different segments with a common core
        mixed = keep(bodies.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("core", "c"), "mixed")
        open_ = bodies.join(mixed, F.col("core") == F.col("c"))
        chunk = F.when(F.col("m") > CHUNK, F.pmod(F.xxhash64("body"), F.ceil(F.col("m") / CHUNK))).otherwise(F.lit(0).cast("long"))
        groups = max(1, mixed.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] // CHUNK)
        wanted = open_.select("k1", "k2", "s0", "s1", "n", F.when(F.col("m") > CHUNK, 1).otherwise(0).cast("long").alias("chunked"), F.pmod(F.xxhash64("core", chunk), F.lit(groups)).alias("g"))
        lists = keep(_lists(wanted), "wanted")
        sorted_ = cut_out(docs, lists).groupBy("g").applyInArrow(sort_group, "kind long, k1 long, k2 long, a long, b long, h1 long, h2 long, n long")
        sorted_ = keep(sorted_, "sorted")
        release(lists)
        rims = sorted_.where("kind = 0").select("k1", "k2", "a", "b")
        windows = sorted_.where("kind = 1")
        met = keep(windows.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").withColumnsRenamed({"h1": "g1", "h2": "g2"}), "met")
        chunked = windows.where("a >= 0").join(met, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_semi").select("k1", "k2", "a", "b")
        # neighbours in a row overlap: each row's spans are a list bounded by its length
        spans = whole.unionByName(rims).unionByName(chunked)
        lists = spans.groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        return materialise(lists, "spans")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with row keys k1, k2 and the list of its spans."""
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"))
    lists = repeated_spans(keyed.where("text IS NOT NULL").select("k1", "k2", "text"))
    return keyed.join(lists, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left"), docs.columns


def remaining(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, kept) of every row: the removed runs (a, b), and the bytes that stay, which needn't be whole characters."""
    d, _ = _with_spans(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                found = merge([(s["a"], s["b"]) for s in batch.column(2)[i].as_py() or []])
                runs.append([{"a": a, "b": b} for a, b in found])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *[b for _, b in found]], [*[a for a, _ in found], len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    ready = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans")
    return ready.mapInArrow(run, "doc_id long, spans array<struct<a:long,b:long>>, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    d, _ = _with_spans(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                found = merge([(s["a"], s["b"]) for s in batch.column(2)[i].as_py() or []])
                kept, at = hashlib.sha256(), 0
                for a, b in found:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in found), len(found), kept.hexdigest()))
            n_bytes, removed, n, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ready = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans")
    return ready.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
