"""Words and n-grams of many texts at once, as 64-bit numbers in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier for polynomial hashes, and the finalizer's constants (splitmix64).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE, np.uint64))])
    return _powers


#: Bytes of plain words: ASCII letters and digits, and all bytes of other characters.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
SPACE_BYTE = np.array([b in b" \t\n\r\f\v" for b in range(256)])


def text_bytes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text starts and the last ends). Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes that are worked on at once; a portion ends where no word goes on.
PORTION = 2_000_000


def in_portions(raw: np.ndarray, at: np.ndarray, apart: np.ndarray, work) -> tuple[np.ndarray, np.ndarray]:
    """``work(raw, at)``, which gives values of words and their number by text, over portions cut at bytes that are ``apart``."""
    if len(raw) <= 2 * PORTION:
        return work(raw, at)
    out, counts, a = [], np.zeros(len(at) - 1, np.int64), 0
    while a < len(raw):
        b = min(a + PORTION, len(raw))
        while b < len(raw) and not (found := apart[raw[b : b + 65_536]]).any():
            b = min(b + 65_536, len(raw))
        b += int(found.argmax()) if b < len(raw) else 0
        values, n = work(raw[a:b], np.clip(at, a, b) - a)
        out.append(values)
        counts += n
        a = b
    return np.concatenate(out), counts


def word_hashes(texts: pa.Array, lower: bool = True, plain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text).

    ``plain``: words are runs of letters and digits, so marks don't count; else runs of anything but ASCII white space.
    """
    apart = ~WORD_BYTE if plain else SPACE_BYTE
    return in_portions(*text_bytes(texts, lower), apart, lambda raw, at: _hash_words(raw, at, apart))


def _hash_words(raw: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~apart[raw]
    edge = np.zeros(len(raw), bool)
    edge[at[:-1][at[:-1] < len(raw)]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    within = np.flatnonzero(inside)
    owner = np.searchsorted(starts, within, side="right") - 1
    place = within - starts[owner]
    values = (raw[within].astype(np.uint64) + np.uint64(1)) * _power_table(int(place.max()) + 1)[place]
    first = np.searchsorted(within, starts)
    sums = np.add.reduceat(values, first)
    counts = np.diff(np.searchsorted(starts, at))
    return mix(sums), counts


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words inside a text, number of them of each text)."""
    if n == 1:
        return words, counts
    out = np.maximum(counts - n + 1, 0)
    total = int(out.sum())
    starts = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(np.cumsum(out) - out, out) + np.repeat(starts, out)
    x = np.zeros(total, np.uint64)
    for k in range(n):
        x = x * BASE + words[at + k]
    return mix(x), out
