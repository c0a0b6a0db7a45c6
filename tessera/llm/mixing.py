"""Mixing sources to target weights by pivotal dependent rounding (operator 8, native).

Every document of a source is to be taken ``target / source_size`` times, which
is a whole number of copies plus a fraction. The whole part is given out; the
fractions are rounded dependently: two units meet, and words move from one to the
other at random until one of them is whole. The expectation of each stays what it
was, and the words of the pair never change, so those of a source don't either.

First the large documents, of more than 1 / ``BIG`` of their source, meet the rest
of it as one unit, the largest first: one is taken or left, and the fraction that
all smaller ones share takes up the difference. If they can't take it up, because
the document is larger than all that is to be taken or left, its choice isn't drawn:
it is the one that misses the target less. Then the others meet in leaves of about
``LEAF`` rows, pair by pair. Each leaf leaves at most one fractional document; these
residuals meet again, ``LEAF`` at a time, up a reduction tree until a source has one,
which a hash decides. So a source misses its target by less than 1 / ``BIG`` of its
size, if its large documents let it. Every draw is a hash of the row and the seed:
reruns agree, and a lost task recomputes the same.

Nulls, ties and clashes: a null text has size 0; rows of size 0 carry no words to
move and are drawn each by its hash; a null source is a source of its
own, last in order; a null doc_id is an ordinary row. Rows that agree in doc_id, text
and source are one unit with as many copies, dealt out evenly among them; so any number
of them is one row of the tree. A source of size 0 has target 0 and takes nothing. Extra
columns are ignored by ``mix_report`` and kept by ``mix_documents``, whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise, scratch

#: Rows that meet in one fold of the tree.
LEAF = 256
#: Documents of more than this part of their source are large; a source has fewer than this.
BIG = 1024
#: Words are runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken this many times at most, and so is a source.
MAX_COPIES = 3
#: Fractions nearer than this to a whole number count as whole.
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of ``sizes`` (source, n_docs, source_size): sources in code-point order, nulls last, weigh ``weights`` in turn.

    The share is water-filled: with sources in order of cap / weight those that
    stop at their cap are a prefix, and the level of the rest follows from the
    prefix sums. The two windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    d = sizes.withColumn("w", w).withColumn("cap", (F.lit(float(MAX_COPIES)) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    d = (
        d.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("w_all", F.sum("w").over(whole))
        .withColumn("no", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
        .withColumn("fits", F.col("cap") >= F.col("level") * F.col("w"))
        # the first source in this order whose cap is not reached sets the level of it and of all after it
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct("no", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("total") <= 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("at"), F.col("cap") / F.col("w")) * F.col("w")))
    return d.select(*sizes.columns, target.alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of structs (k, h, p, u, ...) of size k: a struct of the decided items, and the last one if still fractional.

    ``left`` is the fractional item carried along. It gets up to its need of words from the next one, or gives up to what
    that one has room for, with probabilities that keep both expectations; either way at least one of the two is whole.
    """

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["left"], x
        need, have = a["k"] * (1.0 - a["p"]), a["k"] * a["p"]
        room, give = b["k"] * (1.0 - b["p"]), b["k"] * b["p"]
        up = b["u"] * (F.least(need, give) + F.least(have, room)) < F.least(have, room)
        pa = F.when(up, F.when(need <= give, 1.0).otherwise(a["p"] + give / a["k"])).otherwise(F.when(have <= room, 0.0).otherwise(a["p"] - room / a["k"]))
        pb = F.when(up, F.when(give <= need, 0.0).otherwise(b["p"] - need / b["k"])).otherwise(F.when(room <= have, 1.0).otherwise(b["p"] + have / b["k"]))
        met = F.array(a.withField("p", pa), b.withField("p", pb))
        whole = lambda i: (i["p"] <= _EPS) | (i["p"] >= 1.0 - _EPS)
        done = F.transform(F.filter(met, whole), lambda i: i.withField("p", F.round(i["p"])))
        both = F.struct(F.concat(acc["done"], done).alias("done"), F.get(F.filter(met, lambda i: ~whole(i)), 0).alias("left"))
        return F.when(acc["left"].isNull(), F.struct(acc["done"].alias("done"), x.alias("left"))).otherwise(both)

    start = F.struct(F.slice(items, 1, 0).alias("done"), F.when(F.lit(False), F.element_at(items, 1)).alias("left"))
    return F.aggregate(items, start, step)


def _large(items: Column, pool: Column, share: Column) -> Column:
    """Pivotal rounding of each of ``items`` (single, -size, h, f, u, ...) against the rest of its source: a struct of (the rest's size and words, decided items with ``take``).

    The rest starts as all single documents, ``pool`` words, each to be taken ``share`` times; a single item leaves it, one
    that stands for several rows (it comes first) was never in it.
    """

    def step(acc: Column, x: Column) -> Column:
        k = (-x["minus"]).cast("double")
        single = x["single"] == 1
        f = F.when(single, F.when(acc["size"] > 0, F.least(F.lit(1.0), acc["words"] / acc["size"])).otherwise(0.0)).otherwise(x["f"])
        own = F.struct(k.alias("k"), f.alias("f"), F.when(single, acc["size"] - k).otherwise(acc["size"]).alias("size"), F.when(single, acc["words"] - k * f).otherwise(acc["words"]).alias("words"))

        def met(o: Column) -> Column:
            over, short = o["k"] * (1.0 - o["f"]) - o["words"], o["words"] + o["k"] * o["f"] - o["size"]
            slack = o["k"] * _EPS
            take = F.when((over <= slack) & (short <= slack), x["u"] < o["f"]).when(over <= slack, True).when(short <= slack, False).otherwise(over <= short)
            words = F.greatest(F.lit(0.0), F.least(o["size"], o["words"] + o["k"] * o["f"] - F.when(take, o["k"]).otherwise(0.0)))
            return F.struct(o["size"].alias("size"), words.alias("words"), F.array_append(acc["done"], x.withField("f", F.when(take, 1.0).otherwise(0.0))).alias("done"))

        return F.element_at(F.transform(F.array(own), met), 1)

    return F.aggregate(items, F.struct(pool.cast("double").alias("size"), (pool * share).alias("words"), F.slice(items, 1, 0).alias("done")), step)


def _decided(docs: DataFrame, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """(doc_id, size, h, n, source_size, target, copies) of every unit of n equal rows of ``docs`` (doc_id, text, source): how often they are taken together."""
    hashed = F.xxhash64("doc_id", "text", "source", F.lit(seed)).alias("h")
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed).groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("n"))
    with scratch() as keep:
        units = keep(units, "units")
        single = F.sum(F.when(F.col("n") == 1, F.col("size")).otherwise(0))
        sizes = units.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"), single.alias("pool"))
        share = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
        part = F.greatest(F.lit(0.0), F.col("share") - F.col("whole"))
        targets = source_targets(sizes, weights).withColumn("share", share).withColumn("whole", F.floor(F.col("share") + _EPS))
        targets = keep(targets.withColumn("part", F.when(part < _EPS, 0.0).otherwise(part)).withColumnRenamed("source", "t_source"), "targets")
        largest = targets.agg(F.max("n_docs")).first()[0] or 0

        # one row per source: far smaller than the documents, joined by key; Spark broadcasts it only under its own size limit
        def shared(per_source: DataFrame) -> DataFrame:
            d = units.join(per_source, units["source"].eqNullSafe(per_source["t_source"])).drop("t_source")
            copies = F.col("n") * F.col("whole") + F.floor(F.col("n") * F.col("part") + _EPS)
            f = F.greatest(F.lit(0.0), F.col("n") * F.col("part") - F.floor(F.col("n") * F.col("part") + _EPS))
            d = d.withColumn("copies", copies.cast("long")).withColumn("f", F.when(f < _EPS, 0.0).otherwise(f))
            return d.withColumn("big", (F.col("size") * BIG > F.col("source_size")) & (F.col("f") > 0))

        carried = ["doc_id", "size", "n", "source_size", "target", "copies"]
        order = [F.when(F.col("n") == 1, 1).otherwise(0).alias("single"), (-F.col("size")).alias("minus"), "h", "f", _uniform(F.col("h"), F.lit(seed + 7)).alias("u"), *carried]
        large = shared(targets).where("big").groupBy("source").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("xs"), F.first("pool").alias("pool"), F.first("part").alias("part"))
        large = keep(large.select("source", _large(F.col("xs"), F.col("pool"), F.col("part")).alias("r")), "large")
        rest = F.when(F.col("r.size") > 0, F.least(F.lit(1.0), F.col("r.words") / F.col("r.size"))).otherwise(0.0)
        left = large.select(F.col("source").alias("l_source"), rest.alias("rest"))
        d = shared(targets.join(left, F.col("t_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")).where("NOT big")
        # what the large ones left to the single others of their source; rows without words are drawn
        p = F.when(F.col("f") == 0, 0.0).when(F.col("size") == 0, F.when(_uniform(F.col("h"), F.lit(seed)) < F.col("f"), 1.0).otherwise(0.0))
        d = d.withColumn("p", p.when(F.col("n") == 1, F.coalesce("rest", "f")).otherwise(F.col("f")))
        sure = (F.col("p") <= _EPS) | (F.col("p") >= 1.0 - _EPS)
        outs = [d.where(sure).select("h", *carried, F.round("p").alias("more")), large.select(F.explode("r.done").alias("x")).select("x.h", *[f"x.{c}" for c in carried], F.col("x.f").alias("more"))]
        items = F.struct(F.col("size").alias("k"), "h", "p", F.lit(0.0).alias("u"), *[c for c in carried if c != "size"])
        for x in _tree(d.where(~sure).select("source", "n_docs", items.alias("x")), largest, seed, keep):
            outs.append(x.select("x.h", *[F.col("x.k").alias("size") if c == "size" else F.col(f"x.{c}") for c in carried], F.col("x.p").alias("more")))
        found = outs[0]
        for x in outs[1:]:
            found = found.unionByName(x)
        return materialise(found.withColumn("copies", F.col("copies") + F.col("more").cast("long")).drop("more"), "mix")


def _tree(frac: DataFrame, largest: int, seed: int, keep) -> list[DataFrame]:
    """Decided items of every level of the reduction tree over ``frac`` (source, n_docs, x); x has k, h, p, u."""
    found = []
    levels = max(1, math.ceil(math.log(max(2, largest), LEAF)))
    level = frac.withColumn("node", F.pmod(F.col("x.h"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / LEAF)).cast("long")))
    for n in range(levels):
        u = _uniform(F.col("x.h"), F.lit(seed + 101 * (n + 1)))
        level = level.select("source", "n_docs", F.col("node").cast("long").alias("node"), F.col("x").withField("u", u).alias("x"))
        # the larger first, so that a small one is left
        met = level.groupBy("source", "node").agg(F.max("n_docs").alias("n_docs"), F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        met = keep(met.select("source", "node", "n_docs", _fold(F.col("xs")).alias("f")), "pivot")
        found.append(met.select(F.explode("f.done").alias("x")))
        level = met.where("f.left IS NOT NULL").select("source", "n_docs", (F.floor(F.col("node") / LEAF)).alias("node"), F.col("f.left").alias("x"))
    # at most one item a source is left: a hash decides it
    last = level.withColumn("x", F.col("x").withField("p", F.when(_uniform(F.col("x.h"), F.lit(seed)) < F.col("x.p"), 1.0).otherwise(0.0)))
    found.append(last.select("x"))
    return found


def _nth(copies: Column, n: Column, nth: Column) -> Column:
    """Copies of the nth of n equal rows, from 1."""
    return F.floor(copies / n) + F.when(nth <= copies % n, 1).otherwise(0)


def mix_report(docs: DataFrame, seed: int = 8, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of every row."""
    units = _decided(docs.select("doc_id", "text", "source"), seed, weights)
    # equal rows come back each; many of them in stretches that are dealt out over the tasks
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LEAF))).alias("stretch")
    each = units.where(F.col("n") <= LEAF).select("*", F.lit(0).cast("long").alias("stretch"))
    if units.where(F.col("n") > LEAF).limit(1).count():
        each = each.unionByName(units.where(F.col("n") > LEAF).select("*", stretches).repartition("h", "stretch"))
    first = F.col("stretch") * LEAF + 1
    each = each.select("*", F.explode(F.sequence(first, F.least(F.col("n"), first + LEAF - 1))).alias("nth"))
    taken = F.col("size") * _nth(F.col("copies"), F.col("n"), F.col("nth"))
    return each.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def assign_copies(docs: DataFrame, seed: int = 8, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(row, copies) for every row of ``docs``: the whole row as a struct, and how often it is taken, 0 to 3.

    Rows stay out of the tree; decisions come back by the row's hash, and those of equal rows are dealt out evenly.
    """
    units = _decided(docs.select("doc_id", "text", "source"), seed, weights)
    per_hash = units.groupBy(F.col("h").alias("d_h")).agg(F.sum("copies").alias("all_copies"), F.sum("n").alias("n_same"))
    d = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text", "source", F.lit(seed)).alias("h"))
    joined = d.join(per_hash, F.col("h") == F.col("d_h")).drop("d_h")
    ones = joined.where("n_same = 1").select("row", F.col("all_copies").cast("int").alias("copies"))
    if units.where("n > 1").limit(1).count() == 0 and per_hash.where("n_same > 1").limit(1).count() == 0:
        return ones
    # rows are numbered within the parts they are written in, and parts by prefix sums: no window holds all equal rows
    again = materialise(joined.where("n_same > 1").withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "equal")
    parts = again.groupBy("h", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("h").alias("p_h"), F.col("part").alias("p_part"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("id"))
    numbered = again.withColumn("nth", nth).join(parts, (F.col("h") == F.col("p_h")) & (F.col("part") == F.col("p_part")))
    return ones.unionByName(numbered.select("row", _nth(F.col("all_copies"), F.col("n_same"), F.col("nth") + F.col("before")).cast("int").alias("copies")))


def mix_documents(docs: DataFrame, seed: int = 8) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as many times as the mix takes it."""
    taken = assign_copies(docs, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
