"""Connected components on DataFrames: union-find as forests of parents, and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, release, scratch

#: Up to so many edges (a few MB) one task finds the components in memory.
IN_ONE_TASK = 100_000


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) for a forest given as (node, parent), each node once: pointers jump to their parent's parent until all are at roots."""
    cur = materialise(parents.select("node", F.col("parent").alias("root"), F.lit(True).alias("moved")), "forest")
    while cur.where("moved").limit(1).count():
        up = cur.select(F.col("node").alias("x"), F.col("root").alias("y"))
        after = materialise(cur.join(up, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"), F.col("y").isNotNull().alias("moved")), "forest")
        release(cur)
        cur = after
    return cur


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest; root is that smallest node."""
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if cur.count() > IN_ONE_TASK:
        return _by_stars(cur)
    out = _in_one_task(cur)
    release(cur)
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        found = [(x, find(x)) for x in list(root)]
        found = [p for p in found if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["node", "root"])

    return materialise(edges.coalesce(1).mapInArrow(run, "node binary, root binary"), "roots")


def _by_stars(cur: DataFrame) -> DataFrame:
    """A large star links each node's larger neighbours to its smallest one, a small star its smaller neighbours.

    When nothing changes, the edges are the stars sought. Minima are pre-aggregated and written before they are
    joined, so that a hub's neighbours are joined in splits. Nothing but two numbers a round reaches the driver.
    """
    before = _print(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with scratch() as keep:
            low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "low")
            large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = keep(large.distinct(), "large")
            least = keep(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "least")
            small = large.join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            after = materialise(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        release(cur)
        cur, told = after, _print(after)
        if told == before:
            break
        before = told
    out = materialise(cur.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    release(cur)
    return out


def _print(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of the edges."""
    r = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root), which are released, after further ``links`` (a, b) between nodes: the links are contracted to roots first."""
    ra = roots.select(F.col("node").alias("na"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("nb"), F.col("root").alias("rb"))
    top = links.join(ra, F.col("a") == F.col("na"), "left").join(rb, F.col("b") == F.col("nb"), "left")
    joined = components(top.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    j = joined.select(F.col("node").alias("x"), F.col("root").alias("y"))
    moved = roots.select("node", "root").join(j, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"))
    out = materialise(moved.unionByName(joined), "roots")
    release(joined, roots)
    return out
