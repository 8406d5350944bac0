"""Removing byte passages that start more than once in the corpus.

Stretches of bytes that share an anchor (see ``anchors``) are gathered in shards.
A shard's stretches are concatenated and their suffixes sorted by Larsson-Sadakane
refinement: ranks of eight bytes first, then only groups of equal suffixes are
sorted again, by the rank of what follows, doubling the depth each time. Kasai's
inequality (``plcp[i + d] >= plcp[i] - d``) carries common prefixes from every
``SPARSE``-th position to the ones after it, so that only the rest is compared.
Windows that lie in one interval of common prefixes of at least a window's length
are equal. Sorted lists of long passages of several shards can be merged by
binary search (:func:`merge`); in the corpus query no window meets another shard.

Edge cases: null and empty texts have no windows; rows with a null id count like
any other; rows that repeat are copies of each other, and rows that share an id
with another text each lose only what their own text repeats; texts shorter than a
window are kept whole; overlapping occurrences count; there are no ties, as every
occurrence goes; very long texts are hashed in pieces and read whole; other
columns, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quiverline.llm import anchors
from quiverline.llm.common import drop, persist

WINDOW, GRAM = 200, 100
#: Bytes of a shard.
SHARD = 4 << 20
SPARSE = 16


def byte_symbols(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint8) for t in texts]


def windows(length: int = WINDOW, hot: int = 4096, crowd: int = 20_000) -> anchors.Windows:
    return anchors.Windows(length, min(GRAM, max(1, length // 2)), byte_symbols, "u1", hot, crowd)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = padded[: len(data)]
    for i in range(1, 8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``data`` (uint8) in their order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    first = _eight(data)
    sa = np.argsort(first)
    # Short suffixes come before longer ones that go on with zeros: by their length, among equals.
    tail = np.minimum(8, n - np.arange(n))
    if n < 8 or (first[max(0, n - 8) :] & np.uint64(0xFF) == 0).any():
        sa = np.lexsort((tail, first))
    new = np.r_[True, (first[sa[1:]] != first[sa[:-1]]) | (tail[sa[1:]] != tail[sa[:-1]])]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's number is its first place
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa] = group
    rank[n] = -1
    depth = 8
    place = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of two or more
    while len(place):
        at = sa[place]
        own, follows = rank[at], rank[np.minimum(at + depth, n)]
        order = np.argsort(own * (n + 2) + follows + 1)  # one number for both, so one sort
        at, own, follows = at[order], own[order], follows[order]
        sa[place] = at
        new = np.r_[True, (own[1:] != own[:-1]) | (follows[1:] != follows[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        rank[at] = place[start]
        alone = new & np.r_[new[1:], True]
        place = place[~alone]
        depth *= 2
    return sa


_BYTE_LIMITS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def _compare(data: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefixes from ``a`` and ``b``, at most ``cap``, of which ``known`` are known."""
    words = _eight(data)
    n = len(data)
    size = np.minimum(known, cap)
    live = np.flatnonzero((size < cap) & (b >= 0))
    while len(live):
        x, y = a[live] + size[live], b[live] + size[live]
        room = np.minimum(n - np.maximum(x, y), 8)
        differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
        lead = 8 - np.searchsorted(_BYTE_LIMITS, differ, side="right")  # leading equal bytes of the eight
        gain = np.maximum(np.minimum(lead, room), 0)
        size[live] += gain
        live = live[(gain == 8) & (size[live] < cap)]
    return np.minimum(size, cap)


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Of each place in ``sa`` the common prefix with the place before, at most ``cap`` (0 for the first)."""
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    sample = np.arange(0, n, SPARSE)
    known = _compare(data, sample, before[sample], np.zeros(len(sample), np.int64), cap + SPARSE)
    at = np.arange(n)
    least = np.maximum(known[at // SPARSE] - at % SPARSE, 0)
    least[before < 0] = 0
    return _compare(data, at, before, least, cap)[sa]


def repeated(parts: list[bytes], window: int) -> list[np.ndarray]:
    """Of each part (all different), whether the window from each of its bytes occurs twice or more in the parts."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    whole = np.arange(len(data)) + window <= np.repeat(ends, sizes)
    sa = suffix_array(data)
    interval = np.cumsum(common_prefixes(data, sa, window) < window)
    valid = whole[sa]
    n = np.bincount(interval[valid], minlength=interval[-1] + 1 if len(interval) else 0)
    out = np.zeros(len(data), bool)
    out[sa] = valid & (n[interval] > 1)
    return [out[e - s : e - s + max(0, s - window + 1)] for s, e in zip(sizes, ends, strict=True)]


def merge(mine: list[bytes], other: list[bytes], window: int) -> list[np.ndarray]:
    """Of each part of one shard, whether the window from each of its bytes occurs in another shard.

    Each window is searched for in the other shard's suffix array by bisection.
    """
    data = np.frombuffer(b"".join(other), dtype=np.uint8)
    raw = data.tobytes()
    sizes = np.array([len(p) for p in other], dtype=int)
    whole = np.arange(len(data)) + window <= np.repeat(np.cumsum(sizes), sizes)
    sa = suffix_array(data)
    sa = sa[whole[sa]]
    out = []
    for part in mine:
        hit = np.zeros(max(0, len(part) - window + 1), bool)
        for i in range(len(hit)):
            want, low, high = part[i : i + window], 0, len(sa)
            while low < high:
                mid = (low + high) // 2
                if raw[sa[mid] : sa[mid] + window] < want:
                    low = mid + 1
                else:
                    high = mid
            hit[i] = low < len(sa) and raw[sa[low] : sa[low] + window] == want
        out.append(hit)
    return out


def _covered(hit: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Ranges of the bytes in windows that start where ``hit`` is set."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield a, b - 1 + window


def _shards(window: int):
    def solve(groups: list[list]) -> Iterator[tuple[int, int, int, int]]:
        where: dict[bytes, list[tuple[int, int, int]]] = {}
        for group in groups:
            for doc, mark, at, _, data in group:
                where.setdefault(data, []).append((doc, mark, at))
        parts = list(where)
        for part, hit in zip(parts, repeated(parts, window), strict=True):
            own = where[part]
            if len(own) > 1:  # the whole stretch occurs again
                hit = np.ones(len(hit), bool)
            for a, b in _covered(hit, window):
                for doc, mark, at in own:
                    yield doc, mark, at + a, at + b

    def work(groups: Iterator[list]) -> Iterator[tuple[int, int, int, int]]:
        held, size = [], 0
        for group in groups:
            if len(group) > 1 and all(x[4] == group[0][4] for x in group):  # copies of one stretch
                for doc, mark, at, _, data in group:
                    yield doc, mark, at, at + len(data)
                continue
            held.append(group)
            size += sum(len(x[4]) for x in group)
            if size >= SHARD:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return work


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = 4096, crowd: int = 20_000) -> DataFrame:
    """Stored table ``id``, ``h`` (see ``anchors.row_key``), ``spans`` (array of byte ranges, which may overlap) of the rows that lose bytes."""
    w = windows(window, hot, crowd)
    first, second = anchors.row_key(id_col, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(first.alias("id"), second.alias("h"), F.col(text_col).alias("text"))
    shared = persist(anchors.shared_anchors(rows, w), "suffix-anchors")
    found = persist(anchors.stretches(rows, shared, w), "suffix-stretches")
    rows, hot_ = found.where("not hot"), anchors.cool(found, w)
    if hot_ is None:
        spans = anchors.grouped(rows, _shards(window))
    else:
        copies = hot_.copies.select("id", "h", F.col("at").alias("a"), (F.col("at") + F.col("n") + window - 1).alias("b"))
        often = hot_.windows.groupBy("key", "key2").agg(F.count("*").alias("times")).where("times > 1").drop("times")
        single = hot_.windows.join(often, ["key", "key2"]).select("id", "h", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
        spans = anchors.grouped(rows.unionByName(hot_.few), _shards(window)).unionByName(copies).unionByName(single)
    out = persist(anchors.spans_by_document(spans), "suffix-spans")
    drop(found)
    drop(shared)
    return out


def runs(spans: list | None) -> list[tuple[int, int]]:
    """The spans as disjoint maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in (spans if spans is not None else ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def digest(text: Column, spans: Column) -> Column:
    """Column ``struct<n_bytes, n_removed, n_spans, kept_sha256>`` of texts and what they lose."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, gone, strict=True):
            data, out = (t or "").encode("utf-8", "replace"), runs(s)
            kept = kept_bytes(data, out)
            rows.append((len(data), len(data) - len(kept), len(out), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run(text, spans)
