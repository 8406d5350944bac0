"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads each word once; at every
position its output links list the pieces that end there, and each relaxes the
best score of that position from the best score where the piece starts (a
single-pass Viterbi). Characters no piece covers fall back to byte pieces, or to
the unknown piece where the model has none. Equal scores go to the longer last
piece.

A character that no longer piece holds (a line break, mostly) stands alone, and
where no piece holds a word mark after another character, no piece crosses the
start of a word; so the best segmentation of a text is made of those of its words.
They are kept in a bounded table of two generations, of which the older goes when
the younger is full.

The pieces' scores are those of the model file. In a model trained as BPE these
are merge ranks, so the best-scoring segmentation is well-defined but need not be
the one that merging in rank order gives; for unigram models it is the model's own.
The model's own normaliser, dummy prefix and treatment of extra blanks are read
from the file and followed.

Edge cases: null text has null ids, empty text no ids; decoding gives back the
text exactly, leading and repeated spaces included (with byte pieces and a model
that changes no text; a literal ``U+2581`` reads as a space, as in the format
itself); ties in score go to the longer last piece; texts of any length are read
whole; rows with null ids and repeated rows are encoded each on their own, as no
row sees another; other columns, whatever their names, play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F

MARK = "▁"
#: Words of a generation of the table that each Python worker keeps (about 250 bytes each).
CACHE_WORDS = 100_000
_UNKNOWN_PENALTY = 10.0
_NONE = float("-inf")


class _Words(dict):
    """Ids of words; a word that is missing is taken from the older generation or made."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
            if len(word) > 64:
                return ids
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message: numbers, or bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


# Field numbers of the model format.
_MODEL_NORMALIZER, _CHARSMAP, _DUMMY_PREFIX, _EXTRA_BLANKS = 3, 2, 3, 4


def normaliser(model: bytes) -> tuple[bool, bool, bool]:
    """Whether the model maps characters, puts a blank first, and removes extra blanks."""
    spec = dict(_fields(next((x for n, x in _fields(model) if n == _MODEL_NORMALIZER), b"")))
    return bool(spec.get(_CHARSMAP)), bool(spec.get(_DUMMY_PREFIX, 1)), bool(spec.get(_EXTRA_BLANKS, 1))


class Codec:
    """``pieces``: (piece, score, kind) by id, kind one of normal, unknown, control, byte, unused. ``normal`` maps a text before anything else."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True, normal: Callable[[str], str] | None = None):
        self.pieces, self.dummy_prefix, self.normal = pieces, dummy_prefix, normal
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == "byte"}
        self.lowest = min((p[1] for p in pieces if p[2] == "normal"), default=0.0) - _UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "normal" and piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (i, len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        splits = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == "normal")
        # A character that no longer piece holds stands alone; what lies between such characters is cut before marks.
        inner = "".join(sorted({c for p, _, kind in pieces if kind == "normal" and len(p) > 1 for c in p} - {MARK}))
        inner = f"[{re.escape(inner)}]" if inner else "[^\\s\\S]"
        self._word = re.compile(rf"(?:{inner}|{MARK})+|[\s\S]" if splits else rf"{MARK}+{inner}*|{inner}+|[\s\S]")
        self._known = _Words(self.viterbi)
        raw = {"byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda p: " \u2047 ".encode(), "control": lambda p: b""}
        self._raw = [raw.get(kind, lambda p: p.encode("utf-8", "replace"))(piece) for piece, _, kind in pieces]
        self._digits = [str(i) for i in range(len(pieces))]

    @classmethod
    def load(cls, model: bytes) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = (("unknown", sp.is_unknown), ("control", sp.is_control), ("byte", sp.is_byte), ("unused", sp.is_unused))
        pieces = [(sp.id_to_piece(i), sp.get_score(i), next((k for k, f in kinds if f(i)), "normal")) for i in range(sp.get_piece_size())]
        maps, prefix, extra = normaliser(model)
        if not maps and not extra:
            return cls(pieces, prefix)

        def normal(text: str) -> str:  # with marks for blanks and the dummy prefix in its place
            out = sp.normalize(text).replace(MARK, " ")
            return out[1:] if prefix and out.startswith(" ") else out

        return cls(pieces, prefix, normal)

    def viterbi(self, word: str) -> tuple[int, ...]:
        n = len(word)
        score, start, piece = [0.0] + [_NONE] * n, [0] * (n + 1), [-1] * (n + 1)
        done, lowest = 0, self.lowest  # positions up to ``done`` are final once a match ends beyond them
        if len(self.automaton):
            for end, (i, size, s) in self.automaton.iter(word):
                while done < end:
                    done += 1
                    if score[done] == _NONE:  # no piece ends here: the character stands alone, if any piece needs it
                        score[done], start[done] = score[done - 1] + lowest, done - 1
                end += 1
                at = end - size
                s += score[at]
                if s > score[end] or s == score[end] and at < start[end]:
                    score[end], start[end], piece[end] = s, at, i
        while done < n:
            done += 1
            if score[done] == _NONE:
                score[done], start[done] = score[done - 1] + lowest, done - 1
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(word[start[at] : at].encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
            at = start[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if self.normal is not None:
            text = self.normal(text)
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        ids = list(chain.from_iterable(map(self._known.__getitem__, self._word.findall(marked))))
        if not self.bytes and self.unknown in ids:  # as the format has it, a run of unknown characters is one piece
            ids = [x for x, before in zip(ids, [-1, *ids]) if x != self.unknown or before != x]
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def listed(self, ids: list[int]) -> str:
        """The ids, comma-joined."""
        return ",".join(map(self._digits.__getitem__, ids))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Lazy:
    """Builds the codec once in each Python worker from the broadcast model file (its size is the vocabulary's)."""

    held: dict[int, Codec] = {}

    @classmethod
    def get(cls, sent) -> Codec:
        if sent.id not in cls.held:
            cls.held[sent.id] = Codec.load(sent.value)
        return cls.held[sent.id]


class _Sent:
    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def send(spark, model: bytes) -> _Sent:
    import zlib

    return _Sent(spark.sparkContext.broadcast(model), zlib.crc32(model))


def encode(sent: _Sent, text: Column) -> Column:
    """Column ``array<int>`` of a text column's ids."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _Lazy.get(sent)
        for texts in parts:
            yield pd.Series([None if t is None else codec.encode(t) for t in texts], dtype=object)

    return run(text)


def decode(sent: _Sent, ids: Column) -> Column:
    """Column with the texts of id arrays."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _Lazy.get(sent)
        for rows in parts:
            yield pd.Series([None if r is None else codec.decode(r) for r in rows], dtype=object)

    return run(ids)


def encode_checked(sent: _Sent, text: Column) -> Column:
    """Column ``struct<tokens, exact>``: a text's ids, and whether decoding them gives it back (true of null), in one pass through Python."""

    @F.pandas_udf("tokens array<int>, exact boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _Lazy.get(sent)
        for texts in parts:
            tokens = [None if t is None else codec.encode(t) for t in texts]
            exact = [t is None or codec.decode(ids) == t for t, ids in zip(texts, tokens, strict=True)]
            yield pd.DataFrame({"tokens": pd.Series(tokens, dtype=object), "exact": pd.Series(exact, dtype=bool)})

    return run(text)


def round_trip(sent: _Sent, text: Column) -> Column:
    """Column ``struct<n_tokens, ids_sha256, exact>``: digest of the ids (comma-joined) and whether decoding gives the text back."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, exact boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _Lazy.get(sent)
        for texts in parts:
            rows = []
            for t in texts:
                ids = codec.encode(t or "")
                rows.append((len(ids), hashlib.sha256(codec.listed(ids).encode()).hexdigest(), codec.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "exact"])

    return run(text)
