"""Runs of periodic words by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``max(24, 3 q)`` words that no neighbour extends keeping period q.

Of the starts in a run of period q there is a multiple of 2^k, 2^k <= max(q, 8), whose dyadic block of 2^k words lies in the
run together with its copy q words on. So for each level k, each block that recurs in its text asks for its occurrences in
the window that begins 2^k words behind it (blocks of 8 words also for the window right behind them). The suffixes that begin with the block
are an interval of the suffix array; a wavelet tree over the array answers range successor: the smallest position of the interval
from a place on. Two occurrences give two candidate periods. Three make a progression, whose difference is the block's own
period: the block and its copies lie in stretches of that period, and a longer period can only be the distance between the
beginnings, or the ends, of two such stretches. Candidates of one period that touch are joined, extended word by word to
both sides and kept if long enough; of equal stretches the smallest period stays (a longer one is its multiple).

Suffixes are sorted by prefix doubling, as far as a text's length asks for: a block of 2^k words matters in texts of 3 * 2^k
words or more. Words are told by 64-bit hashes and belong to their texts, so several texts share an array and no occurrence crosses
texts. Texts are independent: there is no shuffle, and a task holds the array of one slice of texts, or of one longer text.

Cases: null texts have no words; texts under 24 words have no runs; repeated rows give repeated results; an empty table gives an empty
result; columns named like results are replaced; whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import free, map_texts, mix64, text_buffers
from covertile.llm.words import SOLID, words

SHORTEST = 24
FIRST = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Wavelet:
    """Wavelet tree (levels from the highest bit, zeros before ones) over the numbers 0 to n - 1 in any order."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        v = values
        for b in range(self.bits - 1, -1, -1):
            one = ((v >> b) & 1).astype(bool)
            raw = np.packbits(one, bitorder="little")
            words64 = np.append(raw, np.zeros(16 - len(raw) % 8, np.uint8)).view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(words64), dtype=np.int64))
            self.levels.append((words64, before, self.n - int(before[-1])))
            v = np.concatenate([v[~one], v[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words64, before, _ = self.levels[level]
        w = at >> 6
        return before[w] + np.bitwise_count(words64[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places lo to hi - 1 are under x (at most n)."""
        count = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            zeros = self.levels[level][2]
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            count += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in places lo to hi - 1."""
        value = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            zeros = self.levels[level][2]
            a, b = self._ones(level, lo), self._ones(level, hi)
            left = (hi - b) - (lo - a)
            one = k >= left
            value = value << 1 | one
            k = np.where(one, k - left, k)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The smallest value of x to ``upto`` in places lo to hi - 1; -1 where there is none."""
        out = np.full(len(lo), -1, np.int64)
        todo = np.flatnonzero((x <= upto) & (x < self.n))
        k = self.below(lo[todo], hi[todo], x[todo])
        some = k < hi[todo] - lo[todo]
        todo, k = todo[some], k[some]
        v = self.kth(lo[todo], hi[todo], k)
        out[todo] = np.where(v <= upto[todo], v, -1)
        return out


def sorted_blocks(ids: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(suffix array, blocks) of words that are told apart by ``ids``; ``end`` and ``size`` are each word's text's.

    blocks: (length, start, lo, hi) for each level, of those that recur: suffixes that begin so are in places lo to hi - 1.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.append(True, ids[order][1:] != ids[order][:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = first[np.cumsum(new) - 1]
    count = np.zeros(n, np.int64)
    count[first] = np.diff(np.append(first, n))
    h, blocks = 1, []
    live = np.flatnonzero(count[rank] > 1)
    while True:
        live = live[size[live] >= 3 * max(h, FIRST)]
        if h >= FIRST:
            at = live[(live % h == 0) & (live + h <= end[live])]
            if len(at):
                blocks.append((h, at, rank[at], rank[at] + count[rank[at]]))
        if not len(live):
            break
        follow = live + h
        inside = follow < end[live]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[live]))
        live, second = live[by], second[by]
        group = rank[live]
        fresh = np.append(True, group[1:] != group[:-1])
        begin = np.flatnonzero(fresh)
        inner = np.arange(len(live)) - np.repeat(begin, np.diff(np.append(begin, len(live))))
        place = group + inner
        order[place] = live
        part = fresh | np.append(True, second[1:] != second[:-1])
        first = np.flatnonzero(part)
        held = np.diff(np.append(first, len(live)))
        rank[live] = np.repeat(place[first], held)
        count[place[first]] = held
        live = live[np.repeat(held, held) > 1]
        h *= 2
    return order, blocks


def _agree(w: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from x and from y on (before them, if step is -1) agree one by one, ``most`` at the most."""
    out = np.zeros(len(x), np.int64)
    todo = np.flatnonzero(most > 0)
    width = 8
    while len(todo):
        following = []
        for part in np.array_split(todo, max(1, len(todo) * width >> 20)):
            t = out[part][:, None] + np.arange(width)
            ok = t < most[part][:, None]
            t = np.minimum(t, most[part][:, None] - 1) * step
            same = ok & (w[x[part][:, None] + t] == w[y[part][:, None] + t])
            got = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            out[part] += got
            following.append(part[(got == width) & (out[part] < most[part])])
        todo = np.concatenate(following)
        width = min(width * 2, 1 << 14)
    return out


def _progressions(w: np.ndarray, i: np.ndarray, d: np.ndarray, q: np.ndarray, h: int, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(block, candidate period) of blocks of length h at i that occur at i + d, i + d + q, ...: distances of stretches of period q."""
    cap = np.full(len(i), 3 * h, np.int64)
    far = _agree(w, i + d - 1, i + d - 1 + q, np.minimum(cap, i + d - begin), -1)
    apart = far < d  # else block and copy lie in one stretch of period q
    near = _agree(w, i - 1, i - 1 + q, np.minimum(cap, i - begin), -1)
    right = i + h - q
    near_end = _agree(w, right, right + q, np.minimum(cap, end - right - q), 1)
    far_end = _agree(w, right + d, right + d + q, np.minimum(cap, end - right - d - q), 1)
    block = np.arange(len(i))
    return [(block[apart], (d - far + near)[apart]), (block[apart], (d + far_end - near_end)[apart])]


def candidates(w: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period): blocks whose words recur ``period`` words on."""
    z = np.zeros(0, np.int64)
    if not len(ids):
        return z, z, z
    order, blocks = sorted_blocks(ids, end, end - begin)
    if not blocks:
        return z, z, z
    tree, place = Wavelet(order), np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for h, i, lo, hi in blocks:
        if h == FIRST:
            v = tree.successor(lo, hi, i + 1, i + h - 1)
            out.append((i[v >= 0], (v - i)[v >= 0], h))
        upto = np.minimum(i + 2 * h - 1, end[i] - h)
        one = tree.successor(lo, hi, i + h, upto)
        some = one >= 0
        i, lo, hi, upto, one = (a[some] for a in (i, lo, hi, upto, one))
        two = tree.successor(lo, hi, one + 1, upto)
        three = np.full(len(i), -1, np.int64)
        some = np.flatnonzero(two >= 0)
        three[some] = tree.successor(lo[some], hi[some], two[some] + 1, upto[some])
        few = three < 0
        out.append((i[few], (one - i)[few], h))
        out.append((i[few & (two >= 0)], (two - i)[few & (two >= 0)], h))
        many = ~few
        i, lo, hi, upto, one, two = (a[many] for a in (i, lo, hi, upto, one, two))
        for block, p in _progressions(w, i, one - i, two - one, h, begin[i], end[i]) if len(i) else []:
            at = i[block]
            good = (p >= h) & (at + p <= upto[block])
            at, p, block = at[good], p[good], block[good]
            real = (place[at + p] >= lo[block]) & (place[at + p] < hi[block])  # the block does occur there
            out.append((at[real], p[real], h))
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), h) for a, _, h in out]), np.concatenate([p for _, p, _ in out])


def runs(w: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start, then period. ``w``: words' hashes, ``ids``: hashes that differ between texts, ``begin``, ``end``: each word's text's."""
    start, length, period = candidates(w, ids, begin, end)
    by = np.lexsort((start, period))
    start, length, period = start[by], length[by], period[by]
    if not len(start):
        return start, length, period
    far = start + length
    new = np.append(True, (period[1:] != period[:-1]) | (start[1:] > far[:-1]))  # blocks of one period have one length, so their ends ascend
    first = np.flatnonzero(new)
    a, b, p = start[first], far[np.append(first[1:], len(start)) - 1], period[first]
    left = _agree(w, a - 1, a - 1 + p, a - begin[a], -1)
    right = _agree(w, np.minimum(b, len(w) - 1), np.minimum(b + p, len(w) - 1), end[a] - b - p, 1)
    a, size = a - left, b - a + left + right + p
    long = size >= np.maximum(SHORTEST, 3 * p)
    a, size, p = a[long], size[long], p[long]
    by = np.lexsort((p, size, a))
    a, size, p = a[by], size[by], p[by]
    one = np.append(True, (a[1:] != a[:-1]) | (size[1:] != size[:-1]))[: len(a)]
    a, size, p = a[one], size[one], p[one]
    by = np.lexsort((p, a))
    return a[by], size[by], p[by]


def _kernel(texts: pa.Array) -> list[pa.Array]:
    raw, offsets = text_buffers(texts)
    first, last, doc, h = words(raw, offsets, SOLID, lower=False)
    n = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    base = np.append(0, np.cumsum(n))
    w_begin, w_end = base[:-1][doc], base[1:][doc]
    of = np.flatnonzero(n[doc] >= SHORTEST)  # the words of texts that can have a run
    moved = np.zeros(len(doc) + 1, np.int64)
    moved[of] = 1
    moved = np.append(0, np.cumsum(moved))[:-1]
    s, size, p = runs(h[of], mix64(h[of] ^ mix64(doc[of].astype(np.uint64) + np.uint64(1))), moved[w_begin[of]], moved[w_end[of]])
    at = of[s] if len(s) else s  # texts are whole, so runs are contiguous in both numberings
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, at + p, 1)
    np.add.at(edge, at + size, -1)
    stays = np.cumsum(edge)[:-1] == 0
    owner = doc[at] if len(at) else at
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    data = raw.tobytes()
    changed = np.zeros(len(texts), bool)
    changed[owner] = True
    kept = []
    for t in range(len(texts)):
        if changed[t]:
            own = slice(base[t], base[t + 1])
            good = stays[own]
            kept.append(b" ".join([data[a:b] for a, b in zip(first[own][good].tolist(), last[own][good].tolist(), strict=True)]))
        else:
            kept.append(b" ".join(data[offsets[t] : offsets[t + 1]].split()))
    found = pa.StructArray.from_arrays([pa.array(at - base[owner] if len(at) else at), pa.array(size), pa.array(p)], names=["start", "length", "period"])
    return [pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), found), pa.array(kept, pa.binary()).cast(pa.string())]


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period in words, by start, then period) and collapsed: the words that are not in a run after its first period, joined by one space."""
    return map_texts(docs, _kernel, f"n_words long, runs {RUNS}, collapsed string", keep_text)


def best(runs_: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties by start, then period."""
    more = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.element_at(F.array_sort(runs_, lambda a, b: F.when(more(a, b), -1).when(more(b, a), 1).otherwise(0)), 1)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    found = find(docs.select("doc_id", "text"))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    top = F.when(F.size("runs") > 0, best(F.col("runs")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * top.length div top.period")
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the registered query reads it: h = crc32(doc_id), g = h div 10; where h mod 10 = 0 and there are n > 0 words, word
    i >= a becomes word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are; without doc_id too."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    names = [free(docs.columns, x) for x in ("_h", "_w")]
    own = docs.select("doc_id", "text", F.coalesce(h, F.lit(1)).alias(names[0]))
    split = F.when(F.col(names[0]) % 10 == 0, F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')"))
    some = own.withColumn(names[1], split)
    g, w = f"({names[0]} div 10)", names[1]
    a, n = f"({g} % size({w}))", f"size({w})"
    p = f"(1 + ({n} - {a}) div (3 + {g} % 8))"
    text = F.expr(f"array_join(transform(sequence(0, {n} - 1), i -> element_at({w}, cast(1 + if(i >= {a}, {a} + (i - {a}) % {p}, i) as int))), ' ')")
    return some.select("doc_id", F.when(F.size(w) > 0, text).otherwise(F.col("text")).alias("text"))
