"""Words of many texts at once, found on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from covertile.llm.common import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that words are made of: ASCII letters and digits, and all of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Everything but space and \\t \\n \\v \\f \\r.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text's number, 64-bit hash of the word, lower-cased or as it is) of every word; words don't cross texts."""
    inside = table[raw]
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = np.unique(offsets[offsets < len(raw)])
    begins[edge] = inside[edge]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = np.unique(offsets[(offsets > 0)]) - 1
    stops[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc, hashes(LOWER[raw] if lower else raw, start, end)


def hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial over each word's bytes, eight at a time, and its length."""
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.append(low, np.zeros(8, np.uint8))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo = np.arange(len(start))
    at = 0
    while len(todo):
        left = size[todo] - at
        v = np.ascontiguousarray(eights[start[todo] + at]).view(np.uint64).ravel()
        part = left < 8
        v = np.where(part, v & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), v)
        h[todo] = mix64((h[todo] ^ v) * FACTOR + np.uint64(at + 1))
        todo = todo[left > 8]
        at += 8
    return h


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every run of ``size`` words; a text with fewer, but some, has one of all its words."""
    n = len(h)
    if not n:
        return doc, h
    texts, first, count = np.unique(doc, return_index=True, return_counts=True)
    out_doc, out = [], []
    if n >= size:
        v = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            v = mix64((v ^ h[k : n - size + 1 + k]) * FACTOR + np.uint64(k + 1))
        whole = doc[: n - size + 1] == doc[size - 1 :]
        out_doc.append(doc[: n - size + 1][whole])
        out.append(v[whole])
    short = count < size
    if short.any():
        v = np.zeros(short.sum(), np.uint64)
        f, c = first[short], count[short]
        for k in range(size - 1):
            has = c > k
            v[has] = mix64((v[has] ^ h[f[has] + k]) * FACTOR + np.uint64(k + 1))
        out_doc.append(texts[short])
        out.append(mix64(v ^ c.astype(np.uint64)))
    return np.concatenate(out_doc), np.concatenate(out)
