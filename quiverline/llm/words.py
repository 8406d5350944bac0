"""Hashes of the words of many texts at once, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quiverline.llm.common import chunks

#: Bytes that are hashed at once; a longer text is cut between words.
SLICE = 1 << 20

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
# White space as bytes.split() has it: blank and 0x09 to 0x0D.
_WORD = np.ones(256, dtype=np.uint8)
_WORD[[32, *range(9, 14)]] = 0

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse, both modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, x, _U)])) for x in (_STEP, _BACK)]
    return _powers[0][:n], _powers[1][:n]


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``, which ends with white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([np.zeros(1, np.uint8), _WORD[raw]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends in turn, as the last byte is white space
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(raw))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[raw] * up)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)), start


def _cut(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about ``SLICE`` bytes, cut at white space."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and _WORD[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of all texts in their order, and the number of words of each text."""
    parts = [(i, part) for i, text in enumerate(texts) for part in (_cut(text) if len(text) > SLICE else (text,))]
    out, sizes = [np.zeros(0, _U)], np.zeros(len(texts), dtype=np.int64)
    for a, b in chunks([len(p) + 1 for _, p in parts], SLICE):
        found, start = _hashes(b" ".join(p for _, p in parts[a:b]) + b" ")
        ends = np.cumsum([len(p) + 1 for _, p in parts[a:b]])
        n = np.diff(np.searchsorted(start, ends), prepend=0)
        np.add.at(sizes, [i for i, _ in parts[a:b]], n)
        out.append(found)
    return np.concatenate(out), sizes
