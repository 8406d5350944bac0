"""Bringing equal windows of a corpus together without shuffling every window.

A window is ``length`` consecutive symbols of a document (bytes, or hashed words).
Its *anchor* is the smallest hash among its runs of ``gram`` symbols, so equal
windows have equal anchors, and neighbouring windows mostly share theirs. One
row for each anchor of a document is enough to find the anchors that occur more
than once; only stretches of windows with such an anchor are then dealt out by
it, and each group holds every occurrence of its windows.

Stretches of anchors with more than ``hot`` occurrences are first counted by their
content (128 bits), with partial aggregation, so that copies come down to one
stretch each. If more than ``crowd`` different stretches of an anchor are left,
they are not dealt out as one group either: their windows go one by one under a
128-bit hash of their own. Nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quiverline.llm.common import chunks, persist, raw_texts
from quiverline.llm.words import mix

#: Symbols that are hashed at once; longer documents are cut into overlapping pieces.
PIECE = 1 << 19

_U = np.uint64


def run_hashes(symbols: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` symbols (uint64), by joining runs of powers of two."""
    odd = mix(np.arange(1, 65, dtype=np.uint64) + _U(1000 * seed)) | _U(1)
    level, step, out, done = symbols, 1, None, 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            if out is None:
                out, done = level, step
            else:
                n = len(symbols) - done - step + 1
                out = out[:n] * odd[2 * bit + 1] + level[done : done + n]
                done += step
        if size >> (bit + 1):
            level = level[: len(level) - step] * odd[2 * bit] + level[step:]
            step *= 2
    return mix(out)


def sliding(values: np.ndarray, width: int, of: np.ufunc = np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours: van Herk's two running minima."""
    n = len(values) - width + 1
    fill = np.iinfo(np.uint64).max if of is np.minimum else 0
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, fill, dtype=np.uint64)]).reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Windows:
    """What a window is. ``symbols`` turns texts into their symbols, ``payload`` symbols into bytes of a stretch."""

    length: int
    gram: int
    symbols: Callable[[list[bytes]], list[np.ndarray]]
    payload: str  # dtype of a symbol in a stretch
    hot: int = 4096
    crowd: int = 10_000

    @property
    def width(self) -> int:
        return self.length - self.gram + 1

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of texts together: symbols, of each symbol the text's number, and of each window that number (-1: no window), its place there and whether it is one."""
        parts: list[tuple[int, int, np.ndarray]] = []
        for i, s in enumerate(self.symbols(texts)):
            for at in range(0, len(s) - self.length + 1, PIECE):
                parts.append((i, at, s[at : at + PIECE + self.length - 1]))
        for a, b in chunks([len(p[2]) for p in parts], PIECE):
            some = parts[a:b]
            symbols = np.concatenate([p[2] for p in some])
            sizes = np.array([len(p[2]) for p in some])
            ends = np.cumsum(sizes)
            n = len(symbols) - self.length + 1
            at = np.arange(n)
            which = np.repeat(np.arange(len(some)), sizes)[:n]
            inside = at + self.length <= ends[which]
            text = np.repeat(np.array([p[0] for p in some]), sizes)
            own = np.where(inside, text[:n], -1)
            place = at - (ends - sizes)[which] + np.array([p[1] for p in some])[which]
            yield symbols, text, own, place, inside

    def anchors(self, symbols: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run, and the anchor of each window (0: no window)."""
        runs = run_hashes(_wide(symbols), self.gram)
        return runs, np.where(inside, sliding(runs, self.width), _U(0))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a row by its content, ``id`` and ``h``: its id and a hash of its text, or two hashes where the id is null.

    Rows that repeat an id with another text are told apart; equal rows are each
    other's copies and lose the same, so they may share a key.
    """
    known = F.col(id_col).isNotNull()
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col), F.lit(1))), F.xxhash64(known, F.col(text_col))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and the column ``_spans``, null in rows without."""
    first, second = row_key(id_col, text_col)
    return docs.withColumns({"_id": first, "_h": second}).join(spans.toDF("_id", "_h", "_spans"), ["_id", "_h"], "left").drop("_id", "_h")


def _wide(symbols: np.ndarray) -> np.ndarray:
    return _BYTES[symbols] if symbols.dtype == np.uint8 else symbols.astype(np.uint64) * _U(0x9E3779B97F4A7C15)


def shared_anchors(docs: DataFrame, w: Windows) -> DataFrame:
    """``anchor``, ``n``, ``low``, ``high``: occurrences and smallest and largest id, of anchors that occur twice or more. ``docs`` has ``id``, ``h`` (see :func:`row_key`) and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), raw_texts(batch.column(1))
            for symbols, text, _, _, inside in w.pieces(texts):
                if not inside.any():
                    continue
                runs, anchor = w.anchors(symbols, inside)
                # A run counts where it is the smallest of some window that holds it.
                padded = np.concatenate([np.zeros(w.width - 1, dtype=np.uint64), anchor, np.zeros(w.width - 1, dtype=np.uint64)])
                at = np.flatnonzero(sliding(padded, w.width, np.maximum) == runs)
                key = np.stack([text[at].astype(np.uint64), runs[at]], axis=1)  # such a window lies in the text that holds the run's start
                order = np.lexsort((key[:, 1], key[:, 0]))
                key = key[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, int)
                n = np.diff(np.r_[first, len(key)])
                key = key[first]
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 1].view(np.int64)), pa.array(ids[key[:, 0].astype(int)].astype(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "id", "n"])

    rows = docs.select("id", "text").mapInArrow(run, "anchor long, id long, n long")
    return rows.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1")


def anchors_of(docs: DataFrame, w: Windows) -> DataFrame:
    """``anchor``, ``id``, ``h`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw_texts(batch.column(2))
            for symbols, _, own, _, inside in w.pieces(texts):
                if not inside.any():
                    continue
                _, anchor = w.anchors(symbols, inside)
                turn = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])] & inside)
                key = _distinct(own[turn], anchor[turn])
                yield pa.RecordBatch.from_arrays([pa.array(key[1].view(np.int64)), pa.array(ids[key[0]]), pa.array(marks[key[0]])], names=["anchor", "id", "h"])

    return docs.select("id", "h", "text").mapInArrow(run, "anchor long, id long, h long")


def _distinct(own: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((anchor, own))
    own, anchor = own[order], anchor[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])] if len(own) else np.zeros(0, bool)
    return own[new], anchor[new]


STRETCH = "hot boolean, key long, s1 long, s2 long, id long, h long, at long, n int, data binary"


def stretches(docs: DataFrame, shared: DataFrame, w: Windows) -> DataFrame:
    """Rows of :data:`STRETCH`: the stretches of windows whose anchor is in ``shared``, of hot ones also what stands for their content."""
    wanted = anchors_of(docs, w).join(shared.select("anchor", (F.col("n") > w.hot).alias("hot")), "anchor")
    of = wanted.groupBy("id", "h").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    rows = docs.select("id", "h", "text").join(of, ["id", "h"])
    most = 4 * w.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw_texts(batch.column(2))
            cold, hot = (_flat(batch.column(i)) for i in (3, 4))
            for symbols, _, own, place, inside in w.pieces(texts):
                if not inside.any():
                    continue
                _, anchor = w.anchors(symbols, inside)
                turn = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
                turn = _cut(turn, len(anchor), most)
                size = np.diff(np.r_[turn, len(anchor)])
                ok = own[turn] >= 0
                turn, size = turn[ok], size[ok]
                key = (own[turn], anchor[turn])
                is_hot = _in(key, hot)
                here = is_hot | _in(key, cold)
                s, n, is_hot = turn[here], size[here], is_hot[here]
                if not len(s):
                    continue
                data = symbols.astype(w.payload)
                held, unit = memoryview(data.tobytes()), data.itemsize
                parts = [bytes(held[a * unit : (a + m + w.length - 1) * unit]) for a, m in zip(s.tolist(), n.tolist(), strict=True)]
                names = np.zeros((len(s), 2), np.int64)
                for i in np.flatnonzero(is_hot).tolist():
                    names[i] = np.frombuffer(hashlib.blake2b(parts[i], digest_size=16).digest(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(is_hot), pa.array(anchor[s].view(np.int64)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(ids[own[s]]), pa.array(marks[own[s]]), pa.array(place[s]), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary())], names=["hot", "key", "s1", "s2", "id", "h", "at", "n", "data"])

    return rows.mapInArrow(run, STRETCH)


@dataclass(frozen=True)
class Hot:
    """``copies``: id, h, at, n, first (smallest id), times of each hot stretch; ``few``: the stretches of each content in its first document, to join the groups; ``windows``: key, key2, id, h, at of those of crowded anchors."""

    copies: DataFrame
    few: DataFrame
    windows: DataFrame


def cool(found: DataFrame, w: Windows) -> Hot | None:
    """The hot stretches of ``found`` (a stored table), counted by content."""
    hot, name = found.where("hot"), ["key", "s1", "s2"]
    if hot.isEmpty():
        return None
    of = persist(hot.groupBy(*name).agg(F.min("id").alias("first"), F.count("*").alias("times")), "anchors-contents")
    copies = hot.select(*name, "id", "h", "at", "n").join(of.where("times > 1"), name)
    one = hot.join(of.select(*name, F.col("first").alias("id")), [*name, "id"], "left_semi")
    crowded = persist(of.groupBy("key").agg(F.count("*").alias("d")).where(F.col("d") > w.crowd).select("key"), "anchors-crowded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, at, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                symbols = _wide(np.frombuffer(data, dtype=w.payload))
                first, second = (run_hashes(symbols, w.length, seed).view(np.int64) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(np.full(len(first), doc)), pa.array(np.full(len(first), mark)), pa.array(np.arange(at, at + len(first)))], names=["key", "key2", "id", "h", "at"])

    windows = one.join(crowded, "key", "left_semi").select("id", "h", "at", "data").mapInArrow(run, "key long, key2 long, id long, h long, at long")
    return Hot(copies, one.join(crowded, "key", "left_anti"), windows)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return _distinct(np.repeat(np.arange(len(lists)), sizes), values)


def _in(key: tuple[np.ndarray, np.ndarray], among: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each (document, anchor) is among those."""
    if not len(among[0]):
        return np.zeros(len(key[0]), bool)
    mixed = lambda k: mix(k[0].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + k[1])
    return np.isin(mixed(key), mixed(among))


def _cut(turn: np.ndarray, end: int, most: int) -> np.ndarray:
    """Starts of stretches, long ones cut every ``most`` windows."""
    size = np.diff(np.r_[turn, end])
    if not (size > most).any():
        return turn
    return np.concatenate([np.arange(a, a + m, most) for a, m in zip(turn.tolist(), size.tolist(), strict=True)])


def grouped(rows: DataFrame, work: Callable[[Iterator[list[tuple[int, int, int, int, bytes]]]], Iterator[tuple[int, int, int, int]]]) -> DataFrame:
    """``id``, ``h``, ``a``, ``b`` that ``work`` makes of the groups of one key, each a list of (id, h, at, n, data) sorted by row and place."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held, last = [], None
        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != last:
                    if held:
                        yield held
                    held, last = [], key
                held.append(tuple(row))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["id", "h", "a", "b"])

        for span in work(groups(batches)):
            out.append(span)
            if len(out) == 20_000:
                yield batch()
                out.clear()
        yield batch()

    dealt = rows.select("key", "id", "h", "at", "n", "data").repartition("key").sortWithinPartitions("key", "id", "h", "at")
    return dealt.mapInArrow(run, "id long, h long, a long, b long")


def spans_by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
