"""Language identification by segmentation-marginalised unigrams (operator 2).

Every language has probabilities over the pieces of one fixed public vocabulary.
A word's likelihood under a language is the sum over all its segmentations into
pieces, computed by a forward recursion; a text's is the product over its words.
Expectation-maximisation (forward-backward over the same lattices) learns the
probabilities from a bounded sample of labelled texts. Words are whole, whatever
their length (that of long ones is rescaled along the way), and all pieces count.

The bound: about ``SAMPLE_DOCS`` documents of each language, chosen by a hash of
doc_id, whole texts. Documents whose crc32(doc_id) mod 4 is 2 are held out and
never learnt from. The number of languages is taken to be small.

Nulls, ties and clashes: a null text, or one without letters, gives ``und`` with
score 0; equal likelihoods go to the first language in code-point order; a null
doc_id is no held-out row and isn't learnt from; a null lang isn't learnt from;
without any labelled row all texts are ``und``; repeated rows come back each;
extra columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textblocks import mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the labelled sample: documents of each language, in expectation.
SAMPLE_DOCS = 400
ITERATIONS = 3
#: Letters from which on a word's sums are rescaled, so that they don't run out of exponent.
LONG = 24
#: Words a task remembers before it forgets all.
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


def load_pieces(path: str) -> dict[str, int]:
    """Piece -> id for the pieces of letters; id 0 stands for any single letter that is no piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        s = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if s.lstrip(_START).isalpha() or s == _START:
            found.setdefault(s, len(found) + 1)
    return found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(words: list[str]) -> np.ndarray:
    """Code points (word, place) of equally long words."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class PieceIndex:
    """Look-up of all stretches of a length in many words at once: a bit per hash tells most that are no pieces, the rest is compared."""

    _BITS = 22

    def __init__(self, pieces: dict[str, int]) -> None:
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        by_length: dict[int, list[str]] = defaultdict(list)
        for s in pieces:
            by_length[len(s)].append(s)
        self.known = {}
        self.bits = np.zeros(1 << self._BITS, bool)
        for n, found in by_length.items():
            codes = _codes(found)
            h = self._start(codes[:, 0])
            for k in range(1, n):
                h = self._next(h, codes[:, k])
            order = np.argsort(h)
            self.known[n] = h[order], np.array([pieces[s] for s in found], np.int32)[order], codes[order]
            self.bits[h >> np.uint64(64 - self._BITS)] = True

    @staticmethod
    def _start(c: np.ndarray) -> np.ndarray:
        return mix(c.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _next(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(h + c.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def lattice(self, words: list[str]) -> np.ndarray:
        """Ids (word, end, length - 1) of the pieces ending at each place of equally long words; -1 where there is none."""
        codes = _codes(words)
        k, n = codes.shape
        out = np.full((k, n, min(n, self.longest)), -1, np.int32)
        out[:, :, 0] = 0
        h = self._start(codes)
        for m in range(1, out.shape[2] + 1):
            if m > 1:
                h = self._next(h[:, : n - m + 1], codes[:, m - 1 :])
            if m not in self.known:
                continue
            known, ids, spelt = self.known[m]
            row, at = np.nonzero(self.bits[h >> np.uint64(64 - self._BITS)])
            i = np.minimum(np.searchsorted(known, h[row, at]), len(known) - 1)
            same = (spelt[i] == codes[row[:, None], at[:, None] + np.arange(m)]).all(axis=1)
            row, at, i = row[same], at[same], i[same]
            out[row, at + m - 1, m - 1] = ids[i]
        return out


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha (word, place, language): summed probability of all segmentations up to each place."""
    words, n, longest = ids.shape
    alpha = np.zeros((words, n + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    for j in range(1, n + 1):
        for m in range(1, min(j, longest) + 1):
            at = np.flatnonzero(ids[:, j - 1, m - 1] >= 0)
            if len(at):
                alpha[at, j] += alpha[at, j - m] * p[ids[at, j - 1, m - 1]]
    return alpha


def _scaled(ids: np.ndarray, p: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``forward``, or of the segmentations from each place on, as (a, s): they are a * exp(s)."""
    words, n, longest = ids.shape
    # id -1 reads the last row
    p = np.concatenate([p, np.zeros((1, p.shape[1]))])
    a = np.zeros((words, n + 1, p.shape[1]))
    s = np.zeros_like(a)
    a[:, n if back else 0] = 1.0
    for j in range(1, n + 1):
        m = np.arange(min(j, longest))
        if back:
            at, near, used = n - j, slice(n - j + 1, n - j + 1 + len(m)), ids[:, n - j + m, m]
            prior = a[:, near]
        else:
            at, near, used = j, slice(j - len(m), j), ids[:, j - 1, : len(m)]
            prior = a[:, near][:, ::-1]
        a[:, at] = (prior * p[used]).sum(axis=1)
        s[:, at] = s[:, at + 1 if back else at - 1]
        if j % longest == 0:
            recent = slice(at, at + longest) if back else slice(at - longest + 1, at + 1)
            top = np.maximum(a[:, recent].max(axis=1, keepdims=True), 1e-300)
            a[:, recent] /= top
            s[:, recent] += np.log(top)
    return a, s


def log_likelihood(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word (word, language)."""
    if ids.shape[1] <= LONG:
        return np.log(np.maximum(forward(ids, p)[:, -1], 1e-300))
    a, s = _scaled(ids, p)
    return np.log(np.maximum(a[:, -1], 1e-300)) + s[:, -1]


def expected(ids: np.ndarray, p: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
    """Add the expected uses of every piece, words weighing ``counts`` (word, language)."""
    words, n, longest = ids.shape
    if n > LONG:
        (alpha, up), (beta, down) = _scaled(ids, p), _scaled(ids, p, back=True)
        level = up[:, n]
    else:
        alpha = forward(ids, p)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1.0
        for j in range(n, 0, -1):
            for m in range(1, min(j, longest) + 1):
                at = np.flatnonzero(ids[:, j - 1, m - 1] >= 0)
                if len(at):
                    beta[at, j - m] += beta[at, j] * p[ids[at, j - 1, m - 1]]
    scale = counts / np.maximum(alpha[:, n], 1e-300)
    for j in range(1, n + 1):
        for m in range(1, min(j, longest) + 1):
            at = np.flatnonzero(ids[:, j - 1, m - 1] >= 0)
            if len(at):
                i = ids[at, j - 1, m - 1]
                use = alpha[at, j - m] * p[i] * beta[at, j] * scale[at]
                if n > LONG:
                    use *= np.exp(up[at, j - m] + down[at, j] - level[at])
                np.add.at(into, i, use)


def fit(counts: dict[str, np.ndarray], langs: list[str], pieces: PieceIndex, iterations: int = ITERATIONS) -> np.ndarray:
    """Piece probabilities (piece, language) from word counts by language."""
    by_length: dict[int, list[tuple[str, np.ndarray]]] = defaultdict(list)
    for word, c in counts.items():
        by_length[len(word) + 1].append((_START + word, c))
    p = np.full((pieces.size, len(langs)), 1e-4)
    lattices = {}
    for n, found in by_length.items():
        for lo in range(0, len(found), 20_000):
            part = found[lo : lo + 20_000]
            lattices[n, lo] = pieces.lattice([w for w, _ in part]), np.array([c for _, c in part], float)
    for _ in range(iterations):
        use = np.full(p.shape, 0.02)
        for ids, c in lattices.values():
            expected(ids, p, c, use)
        p = use / use.sum(axis=0)
    return p


class Scorer:
    """Log-likelihoods of texts under every language; words already met are looked up."""

    def __init__(self, langs: list[str], pieces: PieceIndex, p: np.ndarray) -> None:
        self.langs, self.pieces, self.p = langs, pieces, p
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(langs)))

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        by_length: dict[int, list[tuple[str, int]]] = defaultdict(list)
        base = len(self.known)
        while base + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k, w in enumerate(words):
            self.known[w] = base + k
            by_length[len(w)].append((_START + w, base + k))
        for found in by_length.values():
            for lo in range(0, len(found), 8192):
                part = found[lo : lo + 8192]
                self.table[[i for _, i in part]] = log_likelihood(self.pieces.lattice([s for s, _ in part]), self.p)

    def score_block(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        bags = [Counter(words_of(t)) if t else Counter() for t in texts]
        fresh = list({w for b in bags for w in b if w not in self.known})
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = list({w for b in bags for w in b})
        if fresh:
            self.learn(fresh)
        out = []
        for b in bags:
            if not any(c.isalpha() for w in b for c in w):
                out.append(("und", 0.0))
                continue
            ids = np.fromiter((self.known[w] for w in b), np.int64, len(b))
            total = np.fromiter(b.values(), float, len(b)) @ self.table[ids]
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities learnt from ``docs`` (doc_id, text, lang)."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((1, 0))
    langs = sorted(sizes)
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / sizes[k])))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(2)), 11).cast("double") / F.lit(float(1 << 53))
    sample = labelled.where(draw < rate)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    found: dict[str, np.ndarray] = {}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        for w in words_of(r[1]):
            found.setdefault(w, np.zeros(len(langs)))[langs.index(r[0])] += r[2]
    return langs, fit(found, langs, PieceIndex(load_pieces(path)))


def _scored(docs: DataFrame, path: str, sample_docs: int, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with __lang and __score; the model is the only thing broadcast: pieces x languages."""
    langs, p = train(docs, path, sample_docs)
    sent = docs.sparkSession.sparkContext.broadcast((langs, p))
    wanted = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value[0], PieceIndex(load_pieces(path)), sent.value[1])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = scorer.score_block(part.column("text").to_pylist())
                cols = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*columns, "__lang", "__score"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in wanted.dtypes if c in columns)
    return wanted.mapInArrow(run, f"{kinds}, __lang string, __score double")


def identify(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    d = _scored(docs, path, sample_docs, ["doc_id"])
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, least: float = 0.5) -> DataFrame:
    """``docs`` without those that have no language: ``und``, or a best language less likely than ``least``."""
    d = _scored(docs, path, sample_docs, docs.columns)
    return d.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*docs.columns)
