"""Token counts as an exact length histogram (operator 1).

Documents are encoded with a public byte-level BPE and aggregated by encoded
length. Suffix sums over the histogram then answer, for every context limit,
how many documents and tokens lie at or above it, what a truncation to it keeps
and which quantile it is; no per-document lengths are kept. ``limits`` answers for
the lengths that occur, ``at_limits`` for any limits, ``quantiles`` for shares.

Nulls, ties and clashes: a null text counts as a document of length 0, as an
empty one does; equal lengths share a row; repeated rows count each; doc_id is
not read; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def load_encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; each task sends one row per length it saw."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoder(path)
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                seen[len(enc.encode_ordinary(t)) if t else 0] += 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(seen.keys(), pa.int64()), "n_docs": pa.array(seen.values(), pa.int64())})

    part = docs.select("text").mapInArrow(count, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, taken as a context limit:

    docs_at_least and tokens_at_least of documents with length >= L, truncated_tokens (sum of min(length, L)),
    total_docs, total_tokens and quantile (share of documents with length <= L).
    Suffix sums go by blocks of lengths: within each block, plus the blocks above.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), zero).alias("tokens_above"),
        F.sum("b_docs").over(every).alias("total_docs"),
        F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = h.withColumn("d_in", F.sum("n_docs").over(within)).withColumn("t_in", F.sum("tokens").over(within)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d_in") + F.col("docs_above"), F.col("t_in") + F.col("tokens_above")
    return d.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_at_least"),
        tokens_ge.alias("tokens_at_least"),
        (F.col("total_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, wanted: list[int]) -> DataFrame:
    """(limit, docs_at_least, tokens_at_least, truncated_tokens, total_docs, total_tokens, quantile) of any limits, as ``limits`` has them, by one aggregate."""
    n, c = F.col("n_tokens"), F.col("n_docs")
    zero = F.lit(0).cast("long")

    def sums(x: int) -> Column:
        above = lambda v: F.coalesce(F.sum(F.when(n >= x, v)), zero)
        upto = F.sum(F.when(n <= x, c)) / F.sum(c)
        return F.struct(F.lit(x).cast("long").alias("limit"), above(c).alias("docs_at_least"), above(n * c).alias("tokens_at_least"), F.coalesce(F.sum(F.least(n, F.lit(x)) * c), zero).alias("truncated_tokens"), F.coalesce(F.sum(c), zero).alias("total_docs"), F.coalesce(F.sum(n * c), zero).alias("total_tokens"), F.coalesce(upto, F.lit(0.0)).alias("quantile"))

    return histogram.agg(F.array(*[sums(x) for x in wanted]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which at least that share of the documents lies; null without documents."""
    least = [F.struct(F.lit(p).alias("share"), F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias("n_tokens")) for p in shares]
    return limits(histogram).agg(F.array(*least).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``limits`` of the documents; the histogram, a row for each length, is written so that texts are encoded once."""
    return limits(materialise(length_histogram(docs, path), "lengths"))
