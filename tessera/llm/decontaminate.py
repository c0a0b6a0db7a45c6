"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 4).

Texts and benchmark items are sequences of words (runs of letters and digits,
lower-cased over A-Z). An item of L words leaks into a document if some passage
of it is within L // 4 word edits of the item; so one of fewer than 4 words leaks where it stands word for word.

Item-sized windows are embedded by CGK random walks, which map edit distance to
Hamming distance: the walk copies the current word and steps on by a random bit
of (step, word), so two sequences fall back into step after an edit. Repeated
samples of a few places of the embedding are the hash keys; windows that share a
key with an item of their length are candidates. The number of repetitions
follows from the target recall. Candidates are verified exactly with a
bit-parallel edit distance against all passages of their region.

Only windows that can match are embedded: within e edits of L words at least
L - 1 - 2 e of the item's word pairs survive, so a window with fewer pairs of
items of that length is out. An edit takes two pairs at most, so the item's first
word stands at most 2 e words before the first pair that survives: windows start
at all of these places, before the row's first word too (the end mark fills them).
This loses nothing.

Items go out in blocks of ``ITEM_BLOCK``, each against all documents. Nulls, ties
and clashes: null or wordless texts have no leaks; items that are null or have
fewer than ``LEAST_WORDS`` words take no part; items with equal words are
reported each; repeated rows come back each; doc_id and item_id may be null;
extra columns are ignored by ``leaks`` and kept by ``drop_leaking``; empty tables
give no leaks.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textblocks import NOT_ALNUM, Words, mix, text_blocks

#: Items in a broadcast block: at 60 words each about 15 MB.
ITEM_BLOCK = 20_000
#: Places sampled for a key, the least share of agreeing places counted on at the threshold, and the recall to reach.
SAMPLE, AGREEMENT, RECALL = 2, 0.3, 0.999
#: Samples taken from each random walk.
PER_WALK = 5
REPETITIONS = math.ceil(math.log(1 / (1 - RECALL)) / AGREEMENT**SAMPLE)
_PAIR_BITS = 24
#: Bytes of text whose windows are gathered at once, and windows that walk at once.
_TEXT_BYTES, WINDOWS = 64 << 20, 16_384


def max_edits(length: int) -> int:
    return length // 4


def embed(words: np.ndarray, seed: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """CGK walks of the rows of ``words`` (n, L): 2 L x n symbols; past the end a row shows 0. Rows may be shorter: ``lengths`` words and then 0.

    A full walk has 3 L steps; at half a step each, the last third mostly shows
    the end mark and tells nothing, so it isn't sampled.
    """
    n, width = words.shape
    flat = np.concatenate([words, np.zeros((n, 1), np.uint64)], axis=1).ravel()
    # a row's place among all words
    at = np.arange(n) * (width + 1)
    ends = at + (width if lengths is None else lengths)
    out = np.empty((2 * width, n), np.uint64)
    for i in range(2 * width):
        symbol = np.take(flat, at, out=out[i], mode="clip")
        step = mix(symbol + np.uint64(((seed << 20) + i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)
        np.minimum(at + step.view(np.int64), ends, out=at)
    return out


@cache
def sampled(length: int) -> np.ndarray:
    """Places of each repetition's sample (repetition, place) for items of a length."""
    rng = np.random.default_rng(length)
    return np.array([rng.choice(2 * length, SAMPLE, replace=False) for _ in range(REPETITIONS)])


def sample_keys(words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(length, first row, last row, repetition, keys) of rows in order of length; rows of like lengths walk together."""
    known, first = np.unique(lengths, return_index=True)
    bounds = list(zip(known.tolist(), first.tolist(), [*first[1:].tolist(), len(lengths)], strict=True))
    while bounds:
        band = [x for x in bounds if 2 * x[0] <= 3 * bounds[0][0]]
        bounds = bounds[len(band) :]
        lo, hi, width = band[0][1], band[-1][2], band[-1][0]
        for w in range(math.ceil(REPETITIONS / PER_WALK)):
            walk = embed(words[lo:hi, :width], w, lengths[lo:hi])
            for length, a, b in band:
                part = walk[:, a - lo : b - lo]
                for r in range(w * PER_WALK, min(REPETITIONS, (w + 1) * PER_WALK)):
                    acc = np.zeros(b - a, np.uint64)
                    for p in sampled(length)[r]:
                        acc = mix(acc + part[p])
                    yield length, a, b, r, acc


def least_distance(pattern: list[int], text: list[int]) -> int:
    """Smallest edit distance between ``pattern`` and any run of ``text`` (bit-parallel, one step a word)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        best = min(best, score)
    return best


class Items:
    """A block of benchmark items ready for matching."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        texts = pa.array([t for _, t in rows], pa.large_string())
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for first, data, offs, _ in text_blocks(texts):
            w = Words(data, offs, NOT_ALNUM)
            for r in range(len(offs) - 1):
                h = w.hash[w.first[r] : w.first[r + 1]]
                if len(h):
                    self.ids.append(rows[first + r][0])
                    self.words.append(h)
        self.bags = [Counter(h.tolist()) for h in self.words]
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.single = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h in self.words if len(h) == 1]]))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(self.words):
            by_length[len(h)].append(i)
            self.pairs[_pair_slots(h)] = True
        # for each word pair: the lengths of the items that have it
        slots = np.concatenate([_pair_slots(h) for h in self.words]) if self.words else np.zeros(0, np.int64)
        lengths = np.concatenate([np.full(len(h) - 1, len(h)) for h in self.words]) if self.words else np.zeros(0, np.int64)
        known = np.unique(np.stack([slots, lengths], axis=1), axis=0)
        self.slots, self.slot_first = np.unique(known[:, 0], return_index=True)
        self.slot_count = np.diff(np.append(self.slot_first, len(known)))
        self.slot_length = known[:, 1]
        # for each length and repetition: the items' keys in order
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {length: [] for length in sorted(by_length)}
        members = np.array([i for length in self.tables for i in by_length[length]], np.int64)
        lengths = np.array([len(self.words[i]) for i in members], np.int64)
        words = np.zeros((len(members), lengths.max(initial=1)), np.uint64)
        for k, i in enumerate(members):
            words[k, : lengths[k]] = self.words[i]
        for length, a, b, _, keys in sample_keys(words, lengths):
            order = np.argsort(keys, kind="stable")
            self.tables[length].append((keys[order], members[a:b][order]))

    def _starts(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, window starts, their rows) of a block that can match an item of that length; a start may lie before its row."""
        h, n = w.hash, len(w.hash)
        if len(self.single):
            at = np.flatnonzero(np.isin(h, self.single))
            if len(at):
                yield 1, at, w.row[at]
        if n < 2:
            return
        slots = _pair_slots(h)
        at = np.flatnonzero(self.pairs[slots])
        at = at[w.row[at] == w.row[at + 1]]
        # each pair counts for the lengths of the items that have it
        k = np.searchsorted(self.slots, slots[at])
        reps = self.slot_count[k]
        place = np.repeat(at, reps)
        of = self.slot_length[np.repeat(self.slot_first[k], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        by = np.argsort(of, kind="stable")
        place, of = place[by], of[by]
        row_end = w.first[w.row + 1]
        for length in self.tables:
            if length == 1:
                continue
            e = max_edits(length)
            mine = place[np.searchsorted(of, length, "left") : np.searchsorted(of, length, "right")]
            if not len(mine):
                continue
            ends = np.minimum(mine + length + e, row_end[mine])
            near = mine[np.searchsorted(mine, ends) - np.arange(len(mine)) >= length - 1 - 2 * e]
            if not len(near):
                continue
            # each place up to 2 e words back once a row; a passage in the row lacks e words in front at most
            row = w.row[near]
            reps = np.full(len(near), 2 * e + 1)
            reps[1:] = np.where(row[1:] == row[:-1], np.minimum(reps[1:], np.diff(near)), reps[1:])
            starts = np.repeat(near, reps) - (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
            row = np.repeat(row, reps)
            held = starts >= w.first[row] - e
            yield length, starts[held], row[held]

    def find(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, edits) for every leak into the texts of a column, the least edits of each.

        The blocks' windows are gathered by length first, so that the walks run over many at a time.
        """
        blocks: list[tuple[int, np.ndarray, np.ndarray]] = []
        windows: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for first, data, offs, _ in text_blocks(column):
            w = Words(data, offs, NOT_ALNUM)
            for length, starts, row in self._starts(w):
                # a window that runs over its row's ends shows the end mark there
                index = starts[:, None] + np.arange(length)
                inside = (index >= w.first[row][:, None]) & (index < w.first[row + 1][:, None])
                window = np.where(inside, w.hash[np.clip(index, 0, len(w.hash) - 1)], np.uint64(0))
                windows[length].append((len(blocks), starts, row, window))
            blocks.append((first, w.hash, w.first))
        wanted: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        parts = [(length, *x) for length in sorted(windows) for x in windows[length]]
        if not parts:
            return []
        length = np.concatenate([np.full(len(x[2]), x[0]) for x in parts])
        block = np.concatenate([np.full(len(x[2]), x[1]) for x in parts])
        start, row = (np.concatenate([x[i] for x in parts]) for i in (2, 3))
        ends = np.cumsum([len(x[2]) for x in parts])
        for lo in range(0, len(length), WINDOWS):
            hi = min(lo + WINDOWS, len(length))
            words = np.zeros((hi - lo, int(length[hi - 1])), np.uint64)
            for x, end in zip(parts, ends.tolist(), strict=True):
                a, b = max(lo, end - len(x[2])), min(hi, end)
                if a < b:
                    words[a - lo : b - lo, : x[0]] = x[4][a - end + len(x[2]) : b - end + len(x[2])]
            for at, item in self._matches(words, length[lo:hi]):
                at += lo
                wanted[int(block[at]), int(row[at]), int(item)].append(int(start[at]))
        out = []
        for (b, row, item), starts in wanted.items():
            first, h, firsts = blocks[b]
            best = self._verify(item, h, int(firsts[row]), int(firsts[row + 1]), sorted(starts))
            if best is not None:
                out.append((first + row, item, best))
        return sorted(out)

    def _matches(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(window, item) pairs of one length that share a key; windows are in order of length."""
        found = [np.zeros((0, 2), np.int64)]
        for length, first, _, r, key in sample_keys(words, lengths):
            known, members = self.tables[length][r]
            a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            some = np.flatnonzero(b > a)
            if len(some):
                reps = b[some] - a[some]
                which = np.repeat(a[some], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                found.append(np.stack([np.repeat(some, reps) + first, members[which]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def _verify(self, item: int, h: np.ndarray, first: int, last: int, starts: list[int]) -> int | None:
        """Least edits between an item and any passage around the starts in a row [first, last); None if over the bound."""
        length = len(self.words[item])
        e = max_edits(length)
        spans: list[list[int]] = []
        for s in starts:
            lo, hi = max(first, s - 2 * e), min(last, s + length + 2 * e)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        best, bag = e + 1, self.bags[item]
        for lo, hi in spans:
            text = h[lo:hi].tolist()
            # within e edits at least L - e words are common
            if sum((Counter(text) & bag).values()) >= length - e:
                best = min(best, least_distance(self.words[item].tolist(), text))
        return best if best <= e else None


def _pair_slots(h: np.ndarray) -> np.ndarray:
    return (mix(mix(h[:-1]) + h[1:]) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block: list[tuple[int | None, str]] = []
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


_READY: dict[str, Items] = {}


def ready(name: str, rows: list[tuple[int | None, str]]) -> Items:
    """The block of this name, prepared by the first task of a worker that needs it; a worker keeps one."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Items(rows)
    return _READY[name]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of at most ``_TEXT_BYTES`` of text at a time; a longer text comes alone."""
    for first, _, offs, _ in text_blocks(batch.column(column), _TEXT_BYTES):
        yield batch.slice(first, len(offs) - 1)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, edits) for every document and item that leaks into it; n_words is the item's length."""
    spark = docs.sparkSession
    found = None
    for block in _blocks(benchmark):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            items = ready(name, sent.value)
            for part in (x for batch in batches for x in _slices(batch, "text")):
                ids = part.column(0).to_pylist()
                got = items.find(part.column(1))
                if got:
                    cols = [[ids[r] for r, _, _ in got], [items.ids[i] for _, i, _ in got], [len(items.words[i]) for _, i, _ in got], [e for _, _, e in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_words", "edits"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_words long, edits long")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, n_words long, edits long")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that any item leaks into."""
    spark = docs.sparkSession
    columns = docs.columns
    for block in _blocks(benchmark):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            items = ready(name, sent.value)
            for part in (x for batch in batches for x in _slices(batch, "text")):
                clean = np.ones(part.num_rows, bool)
                clean[[r for r, _, _ in items.find(part.column("text"))]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*columns)
