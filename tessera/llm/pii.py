r"""Personal data and what reveals it (operator 6, native).

Base spans come from four fixed patterns. On top, sanitisation by information:
a protected entity is a base value; over the whole corpus, the terms near it are
counted, and a term that makes an entity far likelier (at least ``BITS`` bits over
its overall share, and at least as likely as not) discloses it. Such terms are
spans of kind ``term`` wherever they occur, and are removed; base spans are
generalised to their kind. A term needs ``SUPPORT`` different contexts of the
entity, so copies of one passage disclose nothing.

All patterns are written without nested repetition: they find the same matches
as the plain forms, in linear time and without recursion on long runs. For cards,
single separators between digits are first turned into one control character.

Nulls, ties and clashes: a null text is an empty one: no spans; a term near
several entities counts if it discloses any; a null doc_id is an ordinary row;
repeated rows come back each, and count each in the corpus figures; extra columns
are ignored by ``report`` and kept by ``sanitise``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise, release, scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as possessive forms with the same leftmost matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Letters of a context on each side of a value, in characters; terms are runs of at least so many letters.
CONTEXT, TERM = 60, r"\p{L}{4,}"
SUPPORT, BITS = 3, 5.0
_BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: an expression repeated inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lens: Column) -> Column:
    """Sums of all elements before each, by blocks, so that long arrays don't cost their square."""
    add = lambda a, b: a + b
    zero = F.lit(0)

    def of(ls: Column, blocks: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            return F.aggregate(F.slice(blocks, F.lit(1), b), zero, add) + F.aggregate(F.slice(ls, b * _BLOCK + 1, i - b * _BLOCK), zero, add)

        return F.transform(ls, before)

    def summed(ls: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor((F.size(ls) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(ls, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))
        return let(blocks, lambda bs: of(ls, bs))

    return let(lens, summed)


_SPANS = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches as structs (start, end, value): code points, end exclusive."""
    p = F.lit(pattern)

    def place(parts: Column) -> Column:
        before = prefix_sums(F.transform(parts, lambda q: q["gap"] + q["len"]))
        return F.zip_with(before, parts, lambda b, q: F.struct((b + q["gap"]).alias("start"), (b + q["gap"] + q["len"]).alias("end"), q["value"].alias("value")))

    def measure(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        parts = F.zip_with(gaps, values, lambda g, v: F.struct(F.char_length(g).alias("gap"), F.char_length(v).alias("len"), v.alias("value")))
        return F.when(F.size(values) == 0, F.array().cast(_SPANS)).otherwise(let(parts, place).cast(_SPANS))

    return let(F.regexp_extract_all(text, p, F.lit(0)), measure)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Digits pass the Luhn sum; only asked of 13 to 19 digits."""

    def worth(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _ip_ok(v: Column) -> Column:
    small = lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= F.lit("255")))
    return F.forall(F.split(v, r"\."), lambda x: small(F.ltrim(x, F.lit("0"))))


def _card_ok(v: Column) -> Column:
    return let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of (start, end, value) for each kind, as columns s_email, s_ip, s_card, s_phone, and the text as t."""
    none = F.array().cast(_SPANS)
    d = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    t = F.col("t")
    joined = F.regexp_replace(F.translate(t, "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")
    some = {"email": F.contains(t, F.lit("@")), "ip": F.col("has_digit"), "card": F.col("has_digit"), "phone": F.contains(t, F.lit("+")) & F.col("has_digit")}
    spans = {"email": found(t, EMAIL), "ip": F.filter(found(t, IP), lambda s: _ip_ok(s["value"])), "card": let(joined, lambda j: F.filter(found(j, CARD), lambda s: _card_ok(s["value"]))), "phone": F.filter(found(t, PHONE), lambda s: _phone_ok(s["value"]))}
    d = d.withColumn("has_digit", t.rlike("[0-9]"))
    d = d.withColumns({f"s_{k}": F.when(some[k], spans[k]).otherwise(none) for k in KINDS})
    return d.drop("has_digit")


def tagged(d: DataFrame) -> Column:
    """All base spans of ``base_spans`` as one array of (kind, start, end), kinds in order, then by start."""

    def of(kind: str) -> Column:
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[of(k) for k in KINDS])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _near(kinds: tuple[str, ...] = KINDS) -> Column:
    """Of a row of ``base_spans`` every (entity, term, context): the terms around each of its values."""

    def of(k: str):
        def one(s: Column) -> Column:
            before = F.substring(F.col("t"), F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"]))
            around = F.concat_ws(" ", before, F.substring(F.col("t"), s["end"] + 1, F.lit(CONTEXT)))
            entity = F.xxhash64(F.lit(k), F.lower(s["value"]))
            return let(around, lambda a: F.transform(F.array_distinct(_terms(a)), lambda x: F.struct(entity.alias("entity"), x.alias("term"), F.xxhash64(a).alias("context"))))

        return one

    return F.flatten(F.concat(*[F.transform(F.col(f"s_{k}"), of(k)) for k in kinds]))


def disclosing_terms(spans: DataFrame) -> DataFrame:
    """(term, bits) of the terms that disclose an entity, from ``base_spans`` of the whole corpus.

    All figures count rows, so a table with each row repeated has the same terms.
    """
    n = spans.count()
    with scratch() as keep:
        # what surrounds the values is all that is needed of most texts
        held = keep(spans.where(F.size(F.concat(*[F.col(f"s_{k}") for k in KINDS])) > 0).select(_near().alias("near")), "held")
        entities = held.select(F.explode(F.array_distinct(F.col("near.entity"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
        # an entity so frequent that no term can add the bits asked for has none
        entities = keep(entities.where(F.log2(F.lit(float(max(1, n))) / F.col("n_entity")) >= BITS), "entities")
        # a term needs SUPPORT contexts of one entity; the distinct rows keep copies of a passage from counting
        near = held.select(F.explode("near").alias("x")).select("x.*").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT)
        both = held.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x"))
        both = both.select("x.*").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
        # rows with the term near any value bound its rows from below: words that are frequent near other values are out before all texts are read
        near_any = held.select(F.explode(F.array_distinct(F.col("near.term"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_any"))
        near = near.join(entities, "entity").join(both, ["entity", "term"]).join(near_any, "term")
        near = keep(near.where(2 * F.col("n_both") >= F.col("n_any")).drop("n_any"), "near")
        if near.limit(1).count() == 0:
            return spans.sparkSession.createDataFrame([], "term string, bits double")
        wanted = near.select(F.col("term").alias("w")).distinct()
        words = spans.select(F.explode(F.array_distinct(_terms(F.col("t")))).alias("term"))
        with_term = words.join(wanted, F.col("term") == F.col("w"), "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
        share = F.col("n_both") / F.col("n_term")
        bits = F.log2(share * F.lit(float(n)) / F.col("n_entity"))
        return materialise(near.join(with_term, "term").where((share >= 0.5) & (bits >= BITS)).groupBy("term").agg(F.max(bits).alias("bits")), "terms")


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with t, s_<kind> and ``all_spans``: base spans, then disclosing terms by start."""
    spans = base_spans(docs)
    terms = disclosing_terms(spans.select("t", *[f"s_{k}" for k in KINDS]))
    if terms.limit(1).count() == 0:
        return spans.withColumn("all_spans", tagged(spans))
    keyed = spans.withColumn("th", F.xxhash64("t"))
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("th") == F.col(b))
    with scratch() as keep:
        words = keyed.select("doc_id", "th", F.explode(F.array_distinct(_terms(F.col("t")))).alias("term"))
        flagged = words.join(terms.select(F.col("term").alias("w")), F.col("term") == F.col("w"), "left_semi").select("doc_id", "th").distinct()
        f = keep(flagged.withColumnsRenamed({"doc_id": "f_id", "th": "f_th"}), "flagged")
        at = keyed.select("doc_id", "th", "t").join(f, same("f_id", "f_th"), "left_semi").dropDuplicates(["doc_id", "th"])
        at = at.select("doc_id", "th", F.explode(found(F.col("t"), TERM)).alias("s"))
        at = at.join(terms.select(F.col("term").alias("w")), F.lower("s.value") == F.col("w"), "left_semi")
        # a row's terms are bounded by its text
        at = at.groupBy(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th")).agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end")))).alias("terms"))
        at = materialise(at, "term_spans")
    release(terms)
    out = keyed.join(at, same("a_id", "a_th"), "left")
    every = F.concat(tagged(out), F.coalesce(F.col("terms"), F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return out.withColumn("all_spans", every).drop("terms", "a_id", "a_th", "th")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    d = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(written(tagged(d)), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with base spans generalised to their kind and terms removed; of overlapping spans the first names the whole."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        grown = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], grown).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))

    return F.aggregate(ordered, start, step, finish)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts (and n_chars, if there is one, to match); other columns as they were."""
    names = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in names]).alias("row"))
    d = with_spans(inner)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size("all_spans") == 0, F.col("text")).otherwise(sanitised(F.col("t"), F.col("all_spans")))
    d = d.withColumn("clean", text)
    kinds = dict(docs.dtypes)
    out = {"text": F.col("clean"), "n_chars": F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.char_length("clean")).cast(kinds.get("n_chars", "long"))} if "n_chars" in names else {"text": F.col("clean")}
    return d.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
