"""Removing word passages that a document with a smaller id has as well.

A window is ``WINDOW`` consecutive words. Documents are streamed in the order of
their ids through suffix automata of reference shards: matching statistics give,
for each word, the longest stretch ending there that an earlier document holds,
and every maximal span of at least ``WINDOW`` words goes. A document joins the
reference only after it was matched.

A shard holds the stretches of one anchor (see ``anchors``), so each window
meets all its other occurrences in exactly one small automaton. Broadcasting the
automata of all shards to all documents would cost the square of the corpus.

Words are symbols of 32 bits; two different windows would have to agree in all
``WINDOW`` of them to be taken for equal.

Edge cases: null texts have no words; rows with a null id have no place in the
order, so they are kept whole and take no part; rows that repeat an id don't make
each other lose words, and each loses only what its own text repeats; ties in ids
are no "smaller"; texts of fewer words than a window are kept whole; very long
texts are hashed in pieces and read whole; other columns, whatever their names,
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quiverline.llm import anchors
from quiverline.llm.common import drop, persist
from quiverline.llm.words import word_hashes

WINDOW, GRAM = 13, 4


def word_symbols(texts: list[bytes]) -> list[np.ndarray]:
    """A symbol for each word of each text, hashed together."""
    hashes, sizes = word_hashes(texts)
    return np.split(hashes >> np.uint64(32), np.cumsum(sizes)[:-1])


def windows(length: int = WINDOW, hot: int = 4096, crowd: int = 10_000) -> anchors.Windows:
    return anchors.Windows(length, min(GRAM, length), word_symbols, "<u4", hot, crowd)


class SuffixAutomaton:
    """Of several sequences, extended online (Blumer et al. 1985)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string of ``p`` followed by ``c``, taken out of ``q``."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, sequence: list[int], least: int) -> Iterator[tuple[int, int]]:
        """Maximal spans of ``sequence`` covered by substrings of ``least`` symbols or more that were added."""
        state = size = 0
        start = end = -1
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size >= least:
                if end >= i + 1 - size:
                    end = i + 1
                    start = min(start, i + 1 - size)
                else:
                    if end >= 0:
                        yield start, end
                    start, end = i + 1 - size, i + 1
        if end >= 0:
            yield start, end


def _shards(least: int):
    def work(groups: Iterator[list]) -> Iterator[tuple[int, int, int, int]]:
        for group in groups:
            if group[0][0] == group[-1][0]:
                continue  # one document: nothing smaller
            reference, known = SuffixAutomaton(), set()
            at = 0
            while at < len(group):
                end = at
                while end < len(group) and group[end][0] == group[at][0]:
                    end += 1
                fresh = []
                for doc, mark, place, n, data in group[at:end]:
                    if data in known:
                        yield doc, mark, place, place + n + least - 1
                        continue
                    sequence = np.frombuffer(data, dtype="<u4").tolist()
                    fresh.append((data, sequence))
                    if at:
                        for a, b in reference.matches(sequence, least):
                            yield doc, mark, place + a, place + b
                for data, sequence in fresh:
                    if data not in known:
                        known.add(data)
                        if end < len(group):
                            reference.add(sequence)
                at = end

    return work


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = 4096, crowd: int = 10_000) -> DataFrame:
    """Stored table ``id``, ``h`` (see ``anchors.row_key``), ``spans`` (array of word ranges, which may overlap) of the rows that lose words."""
    w = windows(window, hot, crowd)
    first, second = anchors.row_key(id_col, text_col)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(first.alias("id"), second.alias("h"), F.col(text_col).alias("text"))
    shared = persist(anchors.shared_anchors(rows, w).where("low < high"), "substring-anchors")
    found = persist(anchors.stretches(rows, shared, w), "substring-stretches")
    rows, hot_ = found.where("not hot"), anchors.cool(found, w)
    if hot_ is None:
        spans = anchors.grouped(rows, _shards(window))
    else:
        copies = hot_.copies.where("id > first").select("id", "h", F.col("at").alias("a"), (F.col("at") + F.col("n") + window - 1).alias("b"))
        first = hot_.windows.groupBy("key", "key2").agg(F.min("id").alias("low"))
        single = hot_.windows.join(first, ["key", "key2"]).where("id > low").select("id", "h", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
        spans = anchors.grouped(rows.unionByName(hot_.few), _shards(window)).unionByName(copies).unionByName(single)
    out = persist(anchors.spans_by_document(spans), "substring-spans")
    drop(found)
    drop(shared)
    return out


def kept_words(text: str | None, spans: list | None) -> tuple[list[bytes], int]:
    """The words left, and the number of all."""
    words = (text or "").encode("utf-8", "replace").split()
    if spans is None or not len(spans):
        return words, len(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        gone[s["a"]] += 1
        gone[min(s["b"], len(words))] -= 1
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in keep.tolist()], len(words)


def digest(text: Column, spans: Column) -> Column:
    """Column ``struct<n_words, n_removed, kept_sha256>`` of texts and what they lose."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, gone, strict=True):
            kept, n = kept_words(t, s)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return run(text, spans)


def kept_text(text: Column, spans: Column) -> Column:
    """Column with the kept words joined by single spaces."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, s)[0]).decode() for t, s in zip(texts, gone, strict=True)], dtype=object)

    return run(text, spans)
