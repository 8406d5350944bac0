"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone
numbers. Positions come from splitting the text at a pattern and adding up the
lengths of what lies between and of the matches. Patterns use possessive
quantifiers and look-behinds that keep the leftmost non-overlapping matches but
make the matcher linear and free of recursion on long runs.

The method on top: each distinct base value is a protected entity, and terms are
words of letters (with inner hyphens and apostrophes). A term is a candidate for
an entity if it stands within ``REACH`` characters of it in at least
``MIN_CONTEXTS`` different contexts. Its corpus co-occurrence says how far it
discloses the entity: with the numbers of documents ``n_c`` that hold the entity,
``n_t`` the term and ``n_ct`` both, anywhere, among ``n``, the disclosed share is
``PMI(c; t) / IC(c) = log(n_ct n / (n_c n_t)) / log(n / n_c)``, 1 if the term
occurs only in documents with that entity. Terms are *removed* from ``REMOVE`` on
and *generalised* from ``GENERALISE`` on, wherever they stand in any document that
holds the entity. As ``n_ct`` is at most ``n_c`` and ``n_t``, and ``n_t`` at least
the number of documents with the term near any entity, or in a part of all texts,
pairs that can't reach the threshold go before all texts are searched for the terms
of the others. Only such bounds come from a part: every count is over all texts.

Documents are told apart by their whole texts: equal texts (copies, repeated rows)
count as one document, whatever their ids, and get the same spans. Edge cases: null
texts are empty; a null id changes nothing; ties of one start go by the order of
``KINDS``; equal contexts are one context; very long texts and texts of many matches
are read whole, in time not much above their length; other columns, whatever their
names, play no part; an empty corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quiverline.llm.common import drop, persist

#: Words of a context reach this many characters to either side of an entity.
REACH = 60
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.7, 0.9
#: Rows up to which tables of terms are broadcast (under 20 MB).
BROADCAST_ROWS = 100_000

# The kinds in the order in which ties at one start are listed.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs fail the test of 14 digits as a whole
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


#: A word; cut ends of a context are marked by U+0001, and what touches one isn't a whole word.
WORD = r"(?<![\p{L}\x01])(?<![\p{L}\x01]['\u2019-])\p{L}++(?:['\u2019-]\p{L}++)*+(?!\x01)"
#: Code points of a block, in which positions are looked up.
BLOCK = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``struct<at, out>``: ``step`` gives from the place so far and an item the next place and an entry of ``out`` (of type ``kind``).

    Items are taken in groups of about the root of their number, since appending to
    an array copies it: so n items make n ** 1.5 copies of entries, not n ** 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def run(part: Column, at: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            end, entry = step(acc["at"], x)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(entry)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), one)

    def whole(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        groups = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda g: F.slice(all_, g * size + 1, size))).otherwise(F.slice(F.array(all_), F.lit(1), F.lit(0)))
        return F.aggregate(groups, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, part: F.aggregate(F.array(run(part, acc["at"])), acc, lambda a, x: F.struct(x["at"].alias("at"), F.concat(a["out"], x["out"]).alias("out"))))

    return _let(items, whole)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from ``a`` to ``b`` of a text in blocks."""
    first = F.floor(a / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
    return F.when(b > a, F.array_join(some, "").substr(a - first * BLOCK + 1, b - a)).otherwise(F.lit(""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    plain = F.reverse(digits)
    double = F.translate(plain, "0123456789", "0246813579")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, double.substr(i, F.lit(1))).otherwise(plain.substr(i, F.lit(1))).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """Array of ``struct<a, b, value>`` of a pattern's matches, in code points."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.length(x["0"])
        b = a + F.length(x["1"])
        return b, F.struct(a.alias("a"), b.alias("b"), x["1"].alias("value"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
    return _fold(pairs, "struct<a:int,b:int,value:string>", step)["out"]


def base_spans(text: Column) -> Column:
    """Sorted array of ``struct<a, rank, b, value>`` of the base kinds of a text without nulls."""
    none = F.array().cast("array<struct<a:int,rank:int,b:int,value:string>>")

    def of(kind: str) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["a"].alias("a"), F.lit(KINDS.index(kind)).alias("rank"), m["b"].alias("b"), m["value"].alias("value")))
        return F.when(F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(PATTERNS[kind]), spans).otherwise(none)

    return F.array_sort(F.concat(*[of(k) for k in PATTERNS]))


def _replaced(text: Column, cuts: Column) -> Column:
    """The text with ``cuts`` (sorted ``struct<a, b, by>``) put in; of what overlaps, the first one's ``by`` stands for all."""

    def pieces(blocks: Column) -> Column:
        def step(at: Column, c: Column) -> tuple[Column, Column]:
            piece = F.when(c["a"] >= at, F.concat(_between(blocks, at, c["a"]), c["by"])).otherwise(F.lit(""))
            return F.greatest(at, c["b"]), piece

        return _let(_fold(cuts, "string", step), lambda x: F.concat(F.array_join(x["out"], ""), _between(blocks, x["at"], F.length(text))))

    return F.when(F.size(cuts) == 0, text).otherwise(_let(_blocks(text), pieces))


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks of the same length for base spans."""
    cuts = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.lit("").alias("by")))

    def pieces(blocks: Column) -> Column:
        def step(at: Column, c: Column) -> tuple[Column, Column]:
            blank = F.repeat(F.lit("\u0002"), F.greatest(c["b"] - F.greatest(c["a"], at), F.lit(0)))
            return F.greatest(at, c["b"]), F.concat(_between(blocks, at, c["a"]), blank)

        return _let(_fold(cuts, "string", step), lambda x: F.concat(F.array_join(x["out"], ""), _between(blocks, x["at"], F.length(text))))

    return F.when(F.size(cuts) == 0, text).otherwise(_let(_blocks(text), pieces))


def text_key(text: Column) -> Column:
    """What names a whole text; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _contexts(text: Column, spans: Column) -> Column:
    """Of each span the entity, a hash of its context and the terms that lie whole in that context."""

    def of(blocks: Column, size: Column) -> Column:
        def one(s: Column) -> Column:
            low, high = F.greatest(s["a"] - REACH, F.lit(0)), F.least(s["b"] + REACH, size)
            left, right = _between(blocks, low, s["a"]), _between(blocks, s["b"], high)
            whole = F.concat(F.when(low > 0, "\u0001").otherwise(""), left, F.lit("\u0001 \u0001"), right, F.when(high < size, "\u0001").otherwise(""))
            return F.struct(
                F.concat(s["rank"].cast("string"), F.lit(":"), F.lower(s["value"])).alias("entity"),
                F.xxhash64(left, right).alias("context"),
                F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lower)).alias("terms"),
            )

        return F.transform(spans, one)

    return _let(F.length(text), lambda size: _let(_blocks(text), lambda blocks: of(blocks, size)))


@dataclass(frozen=True)
class Sanitiser:
    """What :func:`analyse` found: ``base`` (id, key, spans) of all rows, ``extra`` (key, terms) of texts with disclosing terms."""

    base: DataFrame
    extra: DataFrame


_NO_TERMS = "array<struct<a:int,b:int,share:double>>"


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Sanitiser:
    """Base spans of every row, and where terms that disclose too much stand."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    near = F.when(F.size("spans") > 0, _contexts(F.col("text"), F.col("spans")))
    base = persist(texts.withColumn("spans", base_spans(F.col("text"))).select("id", "key", "spans", near.alias("near")), "pii-base")
    seen = base.where("near is not null").select("key", F.explode("near").alias("n")).select("key", "n.entity", "n.context", F.explode("n.terms").alias("term"))
    pairs = seen.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS)
    pairs = persist(pairs.select("entity", "term"), "pii-pairs")
    slim = base.drop("near")
    none = Sanitiser(slim, docs.sparkSession.createDataFrame([], f"key string, terms {_NO_TERMS}"))
    if pairs.isEmpty():
        return none
    n = float(base.select("key").distinct().count())
    held = base.where("near is not null").select("key", F.explode("near.entity").alias("entity")).join(pairs.select("entity").distinct(), "entity", "left_semi").distinct()
    n_c = held.groupBy("entity").agg(F.count("*").alias("n_c"))
    around = seen.select("term", "key").join(pairs.select("term").distinct(), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("low"))
    around = persist(around, "pii-around")

    def able_by(counts: DataFrame, low: DataFrame) -> DataFrame:
        """The pairs that can reach the threshold as far as ``low`` (term, low) bounds ``n_t`` from below."""
        best = F.log(n / F.greatest("n_c", F.coalesce("low", F.lit(1))))
        return counts.join(_small(low), "term", "left").where(GENERALISE * F.log(n / F.col("n_c")) <= best + 1e-9).select("entity", "term", "n_c")

    def words(of: DataFrame, wanted: DataFrame) -> DataFrame:
        """``key``, ``term``: which of the wanted terms each text holds; other words don't leave a task."""
        every = of.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term")).select("key", F.lower("term").alias("term"))
        return every.join(_small(wanted), "term", "left_semi").distinct()

    near_able = persist(able_by(pairs.join(n_c, "entity").where(F.col("n_c") < n), around), "pii-near")
    if near_able.isEmpty():
        return none
    # Common words are most of the matches. What a sixteenth of the texts holds bounds their number from below, and
    # few pairs with common words outlive that bound, so all texts are then searched for the terms of the others.
    part = words(texts.where(F.col("key").startswith("0")), near_able.select("term").distinct())
    part = persist(part.groupBy("term").agg(F.count("*").alias("low")), "pii-part")
    able = persist(able_by(near_able, part), "pii-able")
    if able.isEmpty():
        return none
    terms_of = persist(words(texts, able.select("term").distinct()), "pii-words")
    n_t = terms_of.groupBy("term").agg(F.count("*").alias("n_t"))
    met = persist(terms_of.join(held, "key").join(_small(able.select("entity", "term")), ["entity", "term"], "left_semi"), "pii-met")
    n_ct = met.groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    pmi = F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    scored = able.join(n_ct, ["entity", "term"]).join(n_t, "term").withColumn("share", pmi / F.log(n / F.col("n_c")))
    disclosing = persist(scored.where(F.col("share") >= GENERALISE).select("entity", "term", "share"), "pii-terms")
    own = met.join(_small(disclosing), ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    own = persist(own.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("known")), "pii-own")
    some = texts.select("key", "text").join(_small(own), "key")
    places = F.transform(located(_masked(F.col("text"), base_spans(F.col("text"))), WORD), lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), F.try_element_at(F.col("known"), F.lower(m["value"])).alias("share")))
    extra = some.select("key", F.filter(places, lambda t: t["share"].isNotNull()).alias("terms")).groupBy("key").agg(F.first("terms").alias("terms"))
    extra = persist(extra, "pii-extra")
    for stored in (pairs, around, near_able, part, able, terms_of, met, disclosing, own):
        drop(stored)
    return Sanitiser(slim, extra)


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def found(s: Sanitiser) -> DataFrame:
    """``id``, ``key``, ``spans`` (base) and ``terms`` (the method's spans, which touch no base span), a row for each input row."""
    return s.base.join(s.extra, "key", "left").withColumn("terms", known_terms(F.col("terms")))


def known_terms(terms: Column) -> Column:
    """The terms; null is none."""
    return F.coalesce(terms, F.array().cast(_NO_TERMS))


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans sorted by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def _rank(term: Column) -> Column:
    return F.when(term["share"] >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised"))


def all_spans(spans: Column, terms: Column) -> Column:
    extra = F.transform(terms, lambda t: F.struct(t["a"].alias("a"), _rank(t).alias("rank"), t["b"].alias("b"), F.lit("").alias("value")))
    return F.array_sort(F.concat(spans, extra))


def redacted(text: Column, spans: Column, terms: Column) -> Column:
    """The text with base spans as ``[KIND]``, generalised terms as ``[TERM]`` and removed terms left out.

    Where base spans of several kinds overlap, what they cover together goes as one,
    under the kind of the first.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.get(marks, s["rank"]).alias("by"))),
        F.transform(terms, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.when(t["share"] >= REMOVE, "").otherwise("[TERM]").alias("by"))),
    ))
    return _let(cuts, lambda all_: _replaced(text, all_))
