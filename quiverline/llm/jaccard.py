"""Exact n-gram Jaccard join with token-combination prefixes, and its components.

A document's set holds the distinct runs of ``SHINGLE`` words (hashed to 64 bits);
documents with equal sets are one. Two sets are linked if their Jaccard
similarity reaches ``percent`` / 100, so that they share at least
``ceil(percent / 100 * n)`` tokens of either size ``n``.

Tokens are ordered by hash, with frequent ones last. Two linked sets then share
two tokens within their prefixes of ``n - ceil(percent / 100 * n) + 2`` tokens (one
more than the usual prefix). Tokens found in at most ``rare`` prefixes are indexed
singly. For the frequent class the prefixes are extended until they hold enough
other tokens; sets that consist mostly of frequent tokens are first compared with
a few pivots of each token, which joins large groups of near copies with one
comparison for each. What is then still in different components meets in families
of sets with common frequent tokens (in large families: common *pairs* of them),
packed block against packed block of like sizes. Candidates pass size and position bounds and the bound that their heads set,
and are verified on their whole sets. Only pairs within one component are ever skipped, so components
are exact.

Edge cases: null, empty and wordless texts have empty sets, linked with nothing;
texts of fewer words than a shingle have one token, the whole sequence; rows with
a null id are on their own (null component); rows that repeat an id count as one
document, with the tokens of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quiverline.llm.anchors import run_hashes
from quiverline.llm.common import drop, persist, raw_texts

SHINGLE, PERCENT = 5, 80
#: Prefixes that a token may be in to be indexed singly.
RARE = 24
#: Pivots of a frequent token that every set with it is compared with.
PIVOTS = 3
#: Sets of a family from which it is formed by pairs of frequent tokens instead of single ones.
FAMILY = 20_000
#: Sets of a block, of which two meet in a group, and their tokens (both as a mean).
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: Ids of sets up to which they are broadcast (under 10 MB) to fetch their texts.
BROADCAST_ROWS = 200_000
#: Sets with frequent tokens, and these tokens, up to which they are broadcast (at most 35 MB).
OFTEN_ROWS, OFTEN_TOKENS = 20_000, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes (uint64) of the distinct runs of ``size`` words."""
    words = [t.translate(_LOWER).split() for t in texts]
    sizes = [len(w) for w in words]
    if not sum(sizes):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    symbols = pd.util.hash_array(np.array([x for w in words for x in w], dtype=object), categorize=True)
    runs = run_hashes(symbols, size) if len(symbols) >= size else symbols
    out, at = [], 0
    for n in sizes:
        own = runs[at : at + n - size + 1] if n >= size else run_hashes(symbols[at : at + n], n) if n else symbols[:0]
        own = np.sort(own)
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
        at += n
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """Least number of tokens that a set of ``n`` shares with a linked one."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + 2)


def heads(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``id``, ``n``, ``s1``, ``s2`` (128 bits that stand for the set), ``head`` (extended prefix) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, head = [], [], [], []
            for tokens in shingle_sets(raw_texts(batch.column(1)), size):
                p = prefix_size(len(tokens), percent)
                n.append(len(tokens))
                s1.append(int(run_hashes(tokens, len(tokens), 3)[0].view(np.int64)) if len(tokens) else 0)
                s2.append(int(run_hashes(tokens, len(tokens), 4)[0].view(np.int64)) if len(tokens) else 0)
                head.append(tokens[: p + max(8, p // 4)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(head, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "head"])

    return docs.select("id", "text").mapInArrow(run, "id long, n int, s1 long, s2 long, head array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id``, ``tokens`` of the documents in ``ids`` (a stored table), in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.view(np.int64) for x in shingle_sets(raw_texts(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])

    some = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.select("id", "text").join(some, "id", "left_semi").mapInArrow(run, "id long, tokens array<long>")


def prefixes(docs: DataFrame, sets: DataFrame, size: int, percent: int, rare: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """``token``, ``id``, ``n``, ``pos`` of the final prefixes, the stored tables they are read from, and what now stores ``sets``: ``id``, ``n``, ``head`` of one document for each set."""
    p = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 2
    p = F.least(p, F.col("n"))
    first = sets.select("id", F.explode(F.slice("head", F.lit(1), p)).alias("token"))
    frequent = persist(first.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > rare).select("token"), "jaccard-frequent")
    # Sets with frequent tokens in their prefixes get others instead, by extending it.
    some = persist(first.join(frequent, "token", "left_semi").select("id").distinct(), "jaccard-affected")
    usual = F.posexplode(F.slice("head", F.lit(1), p)).alias("pos", "token")
    if some.isEmpty():
        return sets.select("id", "n", usual).select("token", "id", "n", "pos"), [frequent, some], sets
    # The heads are dealt out once, for all that reads either kind of them later.
    flagged = persist(sets.join(some.withColumn("extend", F.lit(True)), "id", "left").withColumn("extend", F.col("extend").isNotNull()), "jaccard-heads")
    drop(sets)
    plain = flagged.where("not extend").select("id", "n", usual)
    marked = _with_class(flagged.where("extend").select("id", "n", "head"), "head", frequent)
    marked = persist(marked.withColumn("p", p), "jaccard-extended")
    enough = F.size("plain") >= F.col("p")
    extended = marked.where(enough).select("id", "n", F.posexplode(F.slice("plain", F.lit(1), F.col("p"))).alias("pos", "token"))
    dense = persist(marked.where(~enough).select("id", "n", "p"), "jaccard-dense")
    full = whole_sets(docs, dense.select("id"), size).groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens")).join(dense, "id")
    full = _with_class(full.select("id", "n", F.array_distinct("tokens").alias("tokens")), "tokens", frequent).withColumn("p", p)
    last = full.select("id", "n", F.posexplode(F.slice(F.concat("plain", "often"), F.lit(1), F.col("p"))).alias("pos", "token"))
    return plain.unionByName(extended).unionByName(last).select("token", "id", "n", "pos"), [frequent, some, marked, dense], flagged


def _with_class(sets: DataFrame, tokens: str, frequent: DataFrame) -> DataFrame:
    """``plain`` and ``often``: the tokens outside and in ``frequent``, each in the order of the hashes."""
    rows = sets.select("id", "n", F.posexplode(tokens).alias("at", "token")).join(frequent.withColumn("f", F.lit(True)), "token", "left")
    own = F.struct("at", "token")
    by = rows.groupBy("id", "n").agg(F.collect_list(F.when(F.col("f").isNull(), own)).alias("a"), F.collect_list(F.when(F.col("f"), own)).alias("b"))
    return by.select("id", "n", F.transform(F.array_sort("a"), lambda x: x["token"]).alias("plain"), F.transform(F.array_sort("b"), lambda x: x["token"]).alias("often"))


def _sizes_fit(a: str, b: str, percent: int):
    return (100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b)))


def _least_overlap(percent: int):
    """100 i >= percent (na + nb - i), for the common number i."""
    return F.ceil(percent * (F.col("na") + F.col("nb")) / (100.0 + percent) - 1e-9)


def within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` (of ``na`` and ``nb`` tokens) that can be linked as far as their heads tell.

    Heads hold the least hashes of a set, so up to the smaller of two last hashes
    the common tokens are known exactly; beyond it, at most all that is left of the
    smaller rest is common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (na, nb), keep = (batch.column(i).to_numpy() for i in (2, 3)), []
            left, right = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                x, y = (side[i].values.to_numpy().view(np.uint64) for side in (left, right))
                ends = [h[-1] for h, n in ((x, na[i]), (y, nb[i])) if len(h) < n]
                if ends:
                    x, y = (h[: np.searchsorted(h, min(ends), "right")] for h in (x, y))
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(na[i] - len(x), nb[i] - len(y))
                keep.append(100 * most >= percent * (na[i] + nb[i] - most))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("head").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("head").alias("y")), "b")
    return both.select("a", "b", F.col("na").cast("long"), F.col("nb").cast("long"), "x", "y").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets are linked. ``pairs`` is a stored table."""
    ids = persist(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    sets = persist(whole_sets(docs, ids, size).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")), "jaccard-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    out = persist(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")
    drop(sets)
    drop(ids)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id``, ``component`` of the vertices of ``edges`` (``a``, ``b``): the smallest id that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014); each round
    is a stored table, and the driver sees two sums of it.
    """
    now = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "components")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = persist(small, "components")
        drop(now)
        now = after
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(sums):
            break
        seen = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _pivot_pairs(rest: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Pairs of each set with a few sets of the same frequent token in other components, the same pivots for all: the smallest id, and the first ones by hashes."""
    chosen = []
    for i in range(pivots):
        drawn = F.xxhash64("id", F.lit(i)) if i else F.lit(0).cast("long")
        pivot = rest.groupBy("token").agg(F.min(F.struct(drawn.alias("h"), "id", "n", "component")).alias("p")).select("token", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.component").alias("pc"))
        chosen.append(rest.join(pivot, "token").where("component != pc").where(_sizes_fit("n", "pn", percent)).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")))
    out = chosen[0]
    for x in chosen[1:]:
        out = out.unionByName(x)
    return out.distinct()


def links(docs: DataFrame, sets: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, pivots: int = PIVOTS, largest: int = FAMILY) -> DataFrame:
    """Links ``a < b`` between sets (by the documents that stand for them) that make up all components."""
    index, sources, sets = prefixes(docs, sets, size, percent, rare)
    counts = persist(index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-counts")
    index = persist(index.join(counts, "token"), "jaccard-index")
    for stored in [counts, *sources]:
        drop(stored)
    one = index.where(F.col("df") <= rare)
    pairs = one.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")).join(one.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")), "token").where("a < b").where(_sizes_fit("na", "nb", percent))
    # Position bound: what is common lies in the tokens seen in common or after the last of them.
    met = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    often = persist(index.where(F.col("df") > rare).select("token", "id", "n", "pos"), "jaccard-often")
    no_often = often.isEmpty()
    if not no_often:
        met = _with_often(met, often)
    fits = F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= _least_overlap(percent)
    met = persist(met.where(fits).select("a", "b", "na", "nb"), "jaccard-met")
    single = persist(within_bound(met, sets, percent), "jaccard-candidates")
    drop(met)
    drop(sets)
    found = verified(docs, single, size, percent)
    drop(single)
    if no_often:
        return found
    often = often.drop("pos")
    label = components(found)
    rest = _apart(often, label)
    if rest.isEmpty():
        return found
    star = persist(_pivot_pairs(rest, percent, pivots), "jaccard-pivots")
    found = persist(found.unionByName(verified(docs, star, size, percent)).distinct(), "jaccard-found")
    rest = _apart(often, components(found))
    if rest.isEmpty():
        return found
    # Sets that are still apart meet in families of sets with common frequent tokens, large families by pairs of tokens.
    family = _families(rest.select("id", F.col("token").alias("key")))
    large = persist(family.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > largest).select("family"), "jaccard-large")
    if not large.isEmpty():
        big = rest.join(family.join(large, "family", "left_semi").select("id"), "id", "left_semi")
        lists = big.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("t"))
        pairs_of = lists.where(F.size("t") > 1).select("id", F.posexplode("t").alias("i", "one"), "t")
        combos = pairs_of.select("id", F.explode(F.transform(F.slice("t", F.col("i") + 2, F.size("t")), lambda two: F.xxhash64("one", two))).alias("key"))
        family = family.join(large, "family", "left_anti").unionByName(_families(combos))
    family = family.join(rest.select("id", "component").distinct(), "id")
    return persist(found.unionByName(_within(docs, persist(family, "jaccard-families"), size, percent)), "jaccard-all")


def _with_often(met: DataFrame, often: DataFrame) -> DataFrame:
    """``met`` with the common frequent tokens before the last token seen in common counted in ``c``."""
    own = persist(often.groupBy("id").agg(F.collect_list(F.struct("token", "pos")).alias("t")), "jaccard-often-of")
    held = own.agg(F.count("*").alias("rows"), F.sum(F.size("t")).alias("tokens")).first()
    side = F.broadcast(own) if held["rows"] <= OFTEN_ROWS and (held["tokens"] or 0) <= OFTEN_TOKENS else own
    both = met.join(side.toDF("a", "x"), "a", "left").join(side.toDF("b", "y"), "b", "left")

    def before(tokens: str, last: str):
        return F.transform(F.filter(tokens, lambda t: t["pos"] < F.col(last)), lambda t: t["token"])

    common = F.coalesce(F.size(F.array_intersect(before("x", "pa"), before("y", "pb"))), F.lit(0))
    # Either side without frequent tokens has none in common.
    return both.withColumn("c", F.col("c") + F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), common).otherwise(0)).drop("x", "y")


def _apart(often: DataFrame, label: DataFrame) -> DataFrame:
    """Stored rows of the frequent tokens whose sets lie in several components, with the component of each."""
    rest = often.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = rest.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    return persist(rest.join(apart, "token", "left_semi"), "jaccard-open")


def _families(keys: DataFrame) -> DataFrame:
    """``id``, ``family`` of the sets that a chain of common keys connects."""
    keys = persist(keys, "jaccard-keys")
    first = keys.groupBy("key").agg(F.min("id").alias("b"))
    return persist(components(keys.join(first, "key").where("id != b").select(F.col("id").alias("a"), "b")).toDF("id", "family"), "jaccard-family")


#: A block of sets: the sets' ids, components and sizes, the block's distinct tokens, and of each set the places of its tokens among them (as compressed differences).
_PACKED = "family long, cls int, own int, ids array<long>, components array<long>, sizes array<int>, words array<long>, places binary"


def _pack(sets: pa.Table) -> pa.Table:
    """One row for the sets of a block. Near copies share most tokens, so it is far smaller than they are."""
    lists = sets.column("tokens").combine_chunks()
    words, places = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    steps = np.diff(places, prepend=0).astype(np.int32)
    row = {name: sets.column(name)[:1].to_pylist() for name in ("family", "cls", "own")}
    row |= {"ids": [sets.column("id").to_numpy()], "components": [sets.column("component").to_numpy()], "sizes": [lists.value_lengths().to_numpy()], "words": [words], "places": [pa.compress(steps.tobytes(), codec="zstd", asbytes=True)]}
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
    return pa.table({name: pa.array(x, kind) for (name, x), kind in zip(row.items(), kinds, strict=True)})


class _Block:
    def __init__(self, row: pa.Table, i: int):
        self.ids, self.components, self.sizes, self.words = (row.column(name)[i].values.to_numpy() for name in ("ids", "components", "sizes", "words"))
        total = int(self.sizes.sum())
        self.places = np.cumsum(np.frombuffer(pa.decompress(row.column("places")[i].as_buffer(), decompressed_size=4 * total, codec="zstd"), dtype=np.int32))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def _within(docs: DataFrame, family: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between sets of one family in different components.

    Linked sets differ in size by 100 / ``percent`` at most, so they are in the same
    class of sizes or in neighbouring ones. The sets of a class are dealt to blocks,
    each is packed once, and blocks of the same and neighbouring classes meet, each
    two of them in a group of its own.
    """
    sets = whole_sets(docs, family.select("id"), size).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    sets = persist(sets.withColumn("n", F.size("tokens")), "jaccard-sets")
    placed = persist(family.join(sets.select("id", "n"), "id").withColumn("cls", F.floor(F.log("n") / math.log(101 / percent)).cast("int")), "jaccard-placed")
    blocks = placed.groupBy("family", "cls").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("nb"))
    rows = placed.drop("n").join(blocks, ["family", "cls"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).join(sets.drop("n"), "id")
    packed = rows.select("family", "cls", "own", "id", "component", "tokens").groupBy("family", "cls", "own").applyInArrow(_pack, _PACKED)
    packed = persist(packed, "jaccard-blocks")
    drop(sets)
    drop(placed)
    # The other block of each meeting, by the own class, the one above and the one below.
    there = packed.select("family", "cls", "own")
    same = there.join(there.withColumnRenamed("own", "other"), ["family", "cls"]).select("family", "cls", "own", F.col("cls").alias("c"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(False).alias("next"))
    over = there.join(there.select("family", (F.col("cls") - 1).alias("cls"), F.col("own").alias("other")), ["family", "cls"])
    low = over.select("family", "cls", "own", F.col("cls").alias("c"), F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("next"))
    high = over.select("family", (F.col("cls") + 1).alias("cls"), F.col("other").alias("own"), F.col("cls").alias("c"), F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("next"))
    meetings = same.unionByName(low).unionByName(high)

    def meet(rows: pa.Table) -> pa.Table:
        left, right = (_Block(rows, i) for i in (0, rows.num_rows - 1))
        a, b = _linked(left, right, percent)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return packed.join(meetings, ["family", "cls", "own"]).drop("cls", "own").groupBy("family", "c", "i", "j", "next").applyInArrow(meet, "a long, b long").distinct()


def _linked(left: _Block, right: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the sets of two blocks, by products of token matrices."""
    common = np.zeros((len(left.ids), len(right.ids)), dtype=np.float32)
    _, *shared = np.intersect1d(left.words, right.words, assume_unique=True, return_indices=True)
    cells = []
    for side, own in zip((left, right), shared, strict=True):
        column = np.full(len(side.words), -1, dtype=np.int64)
        column[own] = np.arange(len(own))
        at = column[side.places]
        order = np.argsort(at, kind="stable")  # by columns, so that a chunk is a range
        cells.append((at[order], side.owner[order], len(side.ids)))
    for low in range(0, len(shared[0]), 8192):
        wide, parts = min(8192, len(shared[0]) - low), []
        for at, owner, n in cells:
            here = slice(*np.searchsorted(at, (low, low + wide)))
            m = np.zeros((n, wide), dtype=np.float32)
            m[owner[here], at[here] - low] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    common = common.astype(np.int64)
    hit = (100 * common >= percent * (left.sizes[:, None] + right.sizes[None, :] - common)) & (left.components[:, None] != right.components[None, :])
    x, y = np.nonzero(hit)
    return left.ids[x], right.ids[y]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, largest: int = FAMILY) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, a row for each input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = persist(heads(rows, size, percent), "jaccard-heads")
    known = own.where("id is not null and n > 0")
    reps = persist(known.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "jaccard-classes")
    sets = known.join(reps.select(F.col("rep").alias("id"), "s1", "s2", "n"), ["id", "s1", "s2", "n"], "left_semi").dropDuplicates(["id"]).select("id", "n", "head")
    slim = persist(own.drop("head"), "jaccard-sizes")
    sets = persist(sets, "jaccard-heads")
    drop(own)
    label = components(links(rows.where("id is not null"), sets, size, percent, rare, largest=largest))
    named = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    return slim.join(named, ["s1", "s2", "n"], "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))
