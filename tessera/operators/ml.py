"""K-means, diagonal Gaussian mixtures and GMM-HMMs on rows (id, features).

Training loops run on the driver, each step a DataFrame aggregate to k rows; only
model parameters and costs reach it. Assignment and densities are column
expressions with the model as literals, so scans stay in generated code and no
row is joined. ``compat`` reproduces quirks of the classic implementation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranking import ranked

PI = 3.14159


def _vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def nearest(x: Column, centroids: list[list[float]]) -> Column:
    """(dist, label) of the nearest centroid; the first of equals."""
    return F.array_min(F.array(*[F.struct(distance(x, _vector(c)).alias("dist"), F.lit(k).alias("label")) for k, c in enumerate(centroids)]))


def uniform_init(rows: DataFrame, k: int, n: int, seed: int | None = None) -> list[list[float]]:
    """Rows i * n / k in order of id; with a seed, one random row of each such interval."""
    rng = np.random.default_rng(seed) if seed is not None else None
    picks = [int(i * n / k) if rng is None else int(rng.integers(int(i * n / k), max(int(i * n / k) + 1, int((i + 1) * n / k)))) for i in range(k)]
    placed = ranked(rows, "id", "_no").where(F.col("_no").isin(picks))
    got = {r["_no"]: r["features"] for r in placed.collect()}
    return [list(got[p]) for p in picks]


@dataclass
class KMeans:
    """Lloyd's iteration; stops after ``max_iter`` rounds or once three rounds in all changed the cost by under ``least`` of it."""

    k: int
    max_iter: int = 100
    least: float = 0.001
    centroids: list[list[float]] = field(default_factory=list)
    iterations: int = 0

    def step(self, rows: DataFrame) -> tuple[list[list[float]], float]:
        """New means (an empty cluster keeps its own) and the average distance before."""
        d = rows.select("features", nearest(F.col("features"), self.centroids).alias("n"))
        dim = len(self.centroids[0])
        sums = d.groupBy("n.label").agg(F.count("*").alias("c"), F.sum("n.dist").alias("cost"), *[F.sum(F.get("features", i)).alias(f"s{i}") for i in range(dim)]).collect()
        means = [list(c) for c in self.centroids]
        for r in sums:
            means[r["label"]] = [r[f"s{i}"] / r["c"] for i in range(dim)]
        n = sum(r["c"] for r in sums)
        return means, sum(r["cost"] for r in sums) / max(n, 1)

    def fit(self, rows: DataFrame, seed: int | None = None) -> KMeans:
        rows = rows.select("id", "features").persist()
        try:
            if not self.centroids:
                self.centroids = uniform_init(rows, self.k, rows.count(), seed)
            last, unchanged = 0.0, 0
            for self.iterations in range(1, self.max_iter + 1):
                self.centroids, cost = self.step(rows)
                if abs(last - cost) < self.least * last:
                    unchanged += 1
                last = cost
                if unchanged >= 3:
                    break
        finally:
            rows.unpersist()
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> KMeans:
        return KMeans(**json.loads(text))

    def assign(self, rows: DataFrame) -> DataFrame:
        n = nearest(F.col("features"), self.centroids)
        return rows.select("*", n.alias("_n")).select(*rows.columns, F.col("_n.label").alias("label"), F.col("_n.dist").alias("dist"))


def log10_prob(p: Column) -> Column:
    return F.when(p > 1e-20, F.log10(p)).otherwise(F.lit(-20.0))


@dataclass
class Gmm:
    """Mixture of diagonal Gaussians: priors, means, variances and floors of the variances."""

    mix: int
    priors: list[float] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)
    floors: list[float] = field(default_factory=list)
    max_iter: int = 100
    least: float = 0.001
    iterations: int = 0

    def component(self, x: Column, j: int) -> Column:
        p: Column | None = None
        for i, (m, v) in enumerate(zip(self.means[j], self.variances[j], strict=True)):
            q = F.lit(1 / math.sqrt(2 * PI * v)) * F.exp((F.get(x, i) - m) * (F.get(x, i) - m) * F.lit(-1 / (2 * v)))
            p = q if p is None else p * q
        return p

    def density(self, x: Column) -> Column:
        total = F.lit(0.0)
        for j in range(self.mix):
            total = total + F.lit(self.priors[j]) * self.component(x, j)
        return total

    def init(self, rows: DataFrame, compat: bool = False) -> Gmm:
        km = KMeans(self.mix).fit(rows)
        dim = len(km.centroids[0])
        self.means = km.centroids
        spread = lambda c: F.sum((c[0] - c[1]) * (c[0] * c[1] if compat else c[0] - c[1]))
        labelled = km.assign(rows)
        mean_of = F.array(*[_vector(m) for m in self.means])
        got = labelled.groupBy("label").agg(F.count("*").alias("c"), *[spread((F.get("features", i), F.get(F.get(mean_of, F.col("label")), i))).alias(f"v{i}") for i in range(dim)]).collect()
        overall = rows.agg(*[F.avg(F.get("features", i)).alias(f"m{i}") for i in range(dim)], *[F.var_pop(F.get("features", i)).alias(f"g{i}") for i in range(dim)], F.count("*").alias("n")).first()
        floors = [max(1e-10, 0.01 * overall[f"g{i}"]) for i in range(dim)]
        # in compatible mode the floors of an earlier training add up
        self.floors = [a + b for a, b in zip(self.floors, floors, strict=True)] if compat and self.floors else floors
        self.priors, self.variances = [0.0] * self.mix, [list(self.floors) for _ in range(self.mix)]
        for r in got:
            self.priors[r["label"]] = r["c"] / overall["n"]
            self.variances[r["label"]] = [max(self.floors[i], r[f"v{i}"] / r["c"]) for i in range(dim)]
        return self

    def step(self, rows: DataFrame) -> float:
        """One EM step: a single aggregate to one row; returns the average log10 likelihood before it."""
        x = F.col("features")
        dim = len(self.means[0])
        d = rows.select("features", self.density(x).alias("p"), *[(F.lit(self.priors[j]) * self.component(x, j)).alias(f"r{j}") for j in range(self.mix)])
        share = lambda j: F.when(F.col("p") > 0, F.col(f"r{j}") / F.col("p")).otherwise(0.0)
        aggs = [F.count("*").alias("n"), F.avg(log10_prob(F.col("p"))).alias("like")]
        for j in range(self.mix):
            aggs += [F.sum(share(j)).alias(f"w{j}")]
            aggs += [F.sum(share(j) * F.get("features", i)).alias(f"m{j}_{i}") for i in range(dim)]
            aggs += [F.sum(share(j) * F.get("features", i) * F.get("features", i)).alias(f"q{j}_{i}") for i in range(dim)]
        r = d.agg(*aggs).first()
        for j in range(self.mix):
            w = r[f"w{j}"]
            self.priors[j] = w / r["n"]
            if w > 0:
                self.means[j] = [r[f"m{j}_{i}"] / w for i in range(dim)]
                self.variances[j] = [max(self.floors[i], r[f"q{j}_{i}"] / w - self.means[j][i] ** 2) for i in range(dim)]
        return r["like"]

    def fit(self, rows: DataFrame, compat: bool = False) -> Gmm:
        rows = rows.select("id", "features").persist()
        try:
            self.init(rows, compat)
            last, unchanged = 0.0, 0
            for self.iterations in range(1, self.max_iter + 1):
                like = self.step(rows)
                if abs(like - last) < self.least * abs(last):
                    unchanged += 1
                last = like
                if unchanged >= 3:
                    break
        finally:
            rows.unpersist()
        return self

    def numpy_density(self, x: np.ndarray) -> np.ndarray:
        v = np.array(self.variances)[:, None, :]
        q = np.exp(-((x[None] - np.array(self.means)[:, None, :]) ** 2) / (2 * v)) / np.sqrt(2 * PI * v)
        return (np.array(self.priors)[:, None] * q.prod(axis=2)).sum(axis=0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Gmm:
        return Gmm(**json.loads(text))


def _log10(p: np.ndarray) -> np.ndarray:
    return np.where(p > 1e-20, np.log10(np.maximum(p, 1e-300)), -20.0)


@dataclass
class Hmm:
    """Left-right hidden Markov model with a mixture for each state; the last transition column is the final state."""

    states: int
    mix: int = 1
    init_p: list[float] = field(default_factory=list)
    tran: list[list[float]] = field(default_factory=list)
    models: list[Gmm] = field(default_factory=list)
    max_iter: int = 100
    iterations: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Hmm:
        raw = json.loads(text)
        return Hmm(**raw | {"models": [Gmm(**m) for m in raw["models"]]})

    def probability(self, seqs: DataFrame) -> DataFrame:
        """(seq_id, score): the score of each sequence's best path."""
        return self.decode(seqs).where("pos = 0").select("seq_id", "score")

    def viterbi(self, x: np.ndarray) -> tuple[list[int], float]:
        """Best states of a sequence, and exp of its average log10 likelihood."""
        s, t = self.states, len(x)
        emit = np.stack([_log10(m.numpy_density(x)) for m in self.models], axis=1)
        tran = _log10(np.array(self.tran))
        best = _log10(np.array(self.init_p)) + emit[0]
        back = np.zeros((t, s), int)
        for i in range(1, t):
            step = best[:, None] + tran[:, :s]
            back[i] = step.argmax(axis=0)
            best = step.max(axis=0) + emit[i]
        best = best + tran[:, s]
        path = [int(best.argmax())]
        for i in range(t - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        return path[::-1], float(np.exp(best.max() / t))

    def decode(self, seqs: DataFrame) -> DataFrame:
        """(seq_id, pos, state, score) for (seq_id, obs array<array<double>>): sequential in time, parallel over sequences."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for sid, obs in zip(b["seq_id"], b["obs"], strict=True):
                    path, score = self.viterbi(np.array([list(o) for o in obs], float))
                    out += [(sid, i, s, score) for i, s in enumerate(path)]
                yield pd.DataFrame(out, columns=["seq_id", "pos", "state", "score"])

        return seqs.where(F.size("obs") > 0).mapInPandas(run, "seq_id long, pos int, state int, score double")

    def _frames(self, seqs: DataFrame) -> DataFrame:
        f = seqs.select("seq_id", F.size("obs").alias("len"), F.posexplode("obs").alias("pos", "features"))
        # in order of sequence and place; an array has fewer than 2^31 places
        return f.withColumn("id", F.col("seq_id").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos"))

    def init(self, seqs: DataFrame) -> Hmm:
        s = self.states
        self.init_p = [0.5] + [0.5 / (s - 1)] * (s - 1) if s > 1 else [1.0]
        self.tran = [[0.5 if j in (i, i + 1) else 0.0 for j in range(s + 1)] for i in range(s)]
        f = self._frames(seqs).withColumn("state", F.least(F.floor(F.col("pos") * s / F.col("len")), F.lit(s - 1)))
        self.models = [Gmm(self.mix).fit(f.where(F.col("state") == i)) for i in range(s)]
        return self

    def fit(self, seqs: DataFrame) -> Hmm:
        """Hard expectation-maximisation; stops after three rounds in a row without gain."""
        seqs = seqs.select("seq_id", "obs").persist()
        self.init(seqs)
        last, still = -math.inf, 0
        for self.iterations in range(1, self.max_iter + 1):
            d = self.decode(seqs).persist()
            like = d.where("pos = 0").agg(F.avg(F.log(F.greatest("score", F.lit(1e-300))))).first()[0]
            w = Window.partitionBy("seq_id").orderBy("pos")
            moves = d.withColumn("to", F.coalesce(F.lead("state").over(w), F.lit(self.states))).groupBy("state", "to").agg(F.count("*").alias("c")).collect()
            starts = d.where("pos = 0").groupBy("state").agg(F.count("*").alias("c")).collect()
            frames = self._frames(seqs).join(d.select("seq_id", "pos", "state"), ["seq_id", "pos"]).persist()
            for r in frames.groupBy("state").agg(F.count("*").alias("c")).collect():
                if r["c"] > 2 * self.mix:
                    self.models[r["state"]] = Gmm(self.mix).fit(frames.where(F.col("state") == r["state"]))
            n = sum(r["c"] for r in starts)
            self.init_p = [0.0] * self.states
            for r in starts:
                self.init_p[r["state"]] = r["c"] / n
            for i in range(self.states):
                row = {r["to"]: r["c"] for r in moves if r["state"] == i}
                if row:
                    self.tran[i] = [row.get(j, 0) / sum(row.values()) for j in range(self.states + 1)]
            frames.unpersist()
            d.unpersist()
            still = still + 1 if like - last < 0.001 * abs(last) else 0
            last = like
            if still >= 3:
                break
        seqs.unpersist()
        return self
