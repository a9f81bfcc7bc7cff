"""Removal of repeated word windows by compacting a De Bruijn graph.

Windows of WIDTH words are edges, from the node of their first WIDTH - 1 words to the node of their last; edges that start at two
places or more are repeated. Every word that a repeated edge covers goes.

1. Nodes are dealt by anchor, the GRAM words in them with the least hash. A run of nodes with one anchor travels as one row with the hashes
   of its nodes and of all edges at them, so a bucket knows all edges of its nodes: it counts them and sees whether a node has
   one repeated edge in and one out. Anchors that occur once are passed over (a bitmap of the others, which grows with their number). Anchors in
   over ``group`` places give way to the least hash of a rarer one in the node; a node without any is a bucket of its own.
   Equal rows travel at most twice from each task, so copies of a passage don't fill a bucket.
2. Buckets compact nonbranching paths as far as their own nodes go: pieces. A piece's name is its last edge, and it knows the edge
   before its first one, which is the last of another bucket's piece. Spark joins by these names double each piece's jump until
   its path's first piece: paths, and where each piece lies in its path. Cycles are cut at the smallest name.
3. Where a document's windows walk along a path, the walk is a source of that path: (document, place, path, place in the path, edges). Counts
   of begins and ends along a path tell which of its edges have two sources; those parts of the walks are the repeated spans.

Words and windows are told by 64-bit hashes, equal texts by 128-bit digests of their words. Texts with over SLICE words are read in overlapping slices.

Cases: null texts have no words; texts under WIDTH words lose nothing; all copies of a repeated text (equal words, whatever is between
them) go entirely from WIDTH words on; repeated rows count as copies; an empty table gives an empty result; doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.llm.common import lookup, map_texts, mix64, pieces, saved, trim, tuned
from covertile.llm.substrings import BASE, INVERSE, _bitmap, _fields, _in, joined_spans
from covertile.llm.words import SOLID, words

WIDTH, GRAM = 35, 16
NODE = WIDTH - 1
SPAN = NODE - GRAM + 1  # places of an anchor in a node
MOST_BITS = 28
#: Nodes of a text that are worked on at once.
SLICE = 1 << 18
#: Places of one anchor from which its nodes take another.
GROUP = 20_000

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.full(max(n, 1 << 16), b, np.uint64)) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place on."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1] + np.uint64(width))


def _least(x: np.ndarray) -> np.ndarray:
    """The least of each SPAN neighbours."""
    step, m = 1, x
    while step * 2 <= SPAN:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (SPAN - step)], m[SPAN - step :]) if SPAN > step else m


def _plain(text: str | None) -> bytes:
    """The words joined by one space; bytes.split() parts at the same six characters."""
    return b" ".join((text or "").encode().split())


def _key(plain: bytes) -> bytes:
    return hashlib.sha256(plain).digest()[:16]


def _hashes(plain: bytes, most: int = 1 << 22) -> np.ndarray:
    """The hashes of the words of one text, read in parts that end between words."""
    out, at = [], 0
    while at < len(plain):
        to = plain.find(b" ", at + most)
        to = len(plain) if to < 0 else to
        raw = np.frombuffer(plain[at:to], np.uint8)
        out.append(words(raw, np.array([0, len(raw)]), SOLID, lower=False)[3])
        at = to + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shard:
    """Slices of texts: word hashes end to end, and for each slice its text's digest, the text's word it begins with, and its own nodes (first, end)."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.hashes: list[np.ndarray] = []
        self.starts: list[int] = []
        self.own: list[tuple[int, int]] = []
        self.held = 0

    def add(self, key: bytes, h: np.ndarray, start: int, lead: int, count: int) -> None:
        self.keys.append(key)
        self.hashes.append(h)
        self.starts.append(start)
        self.own.append((self.held + lead, self.held + lead + count))
        self.held += len(h)


def shards(batch: pa.RecordBatch, met: set[bytes], most: int) -> Iterator[Shard]:
    """The texts of a batch that the task has not met and that have an edge."""
    for part in pieces(batch, 1 << 20):
        plain = [t for t in map(_plain, part.column("text").to_pylist()) if t.count(b" ") >= WIDTH - 1]
        fresh = []
        for t in plain:
            k = _key(t)
            if k not in met:
                met.add(k)
                fresh.append((k, t))
        short = [(k, t) for k, t in fresh if len(t) <= 1 << 20]
        raw = np.frombuffer(b"".join(t for _, t in short), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for _, t in short])).astype(np.int64)
        _, _, doc, h = words(raw, offsets, SOLID, lower=False)
        cut = np.searchsorted(doc, np.arange(len(short) + 1))
        texts = [(k, h[cut[i] : cut[i + 1]]) for i, (k, _) in enumerate(short)] + [(k, _hashes(t)) for k, t in fresh if len(t) > 1 << 20]
        shard = Shard()
        for k, h in texts:
            n = len(h) - NODE + 1
            for at in range(0, n, most):
                to, lead = min(n, at + most), int(at > 0)
                if shard.held and shard.held + to - at > most:
                    yield shard
                    shard = Shard()
                shard.add(k, h[at - lead : to + NODE], at - lead, lead, to - at)
        if shard.held:
            yield shard


class Nodes:
    """All nodes of a shard: own (worked on here), anchor and its place, slice."""

    def __init__(self, s: Shard) -> None:
        h = np.concatenate(s.hashes)
        self.first = np.append(0, np.cumsum([len(x) for x in s.hashes]))
        self.n = max(0, len(h) - NODE + 1)
        self.gram = rolled(h, GRAM)
        low = np.uint64((1 << 26) - 1)
        least = _least((self.gram & ~low) | np.arange(len(self.gram), dtype=np.uint64))
        self.place = (least & low).astype(np.int64)
        self.anchor = self.gram[self.place]
        edge = np.zeros(self.n + 1, np.int64)
        lo, hi = np.array(s.own).T
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        self.own = np.cumsum(edge)[:-1] > 0
        self.slice = np.searchsorted(self.first, np.arange(self.n), side="right") - 1
        self.words = h


def anchors(docs: DataFrame, most: int = SLICE) -> DataFrame:
    """(b, n): in how many places each anchor is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for s in shards(batch, met, most):
                x = Nodes(s)
                new = x.own.copy()
                new[1:] &= (x.place[1:] != x.place[:-1]) | ~x.own[:-1]
                yield _fields({"b": pa.array(x.anchor[new].view(np.int64))})
        trim()

    return docs.select("text").mapInArrow(run, "b long").groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def _segments(docs: DataFrame, wanted, common, most: int) -> DataFrame:
    """(a, sid, k, s, c, l, r, body): runs of nodes of one anchor: anchor, digest of the row's content, text, first node's word, nodes; l: 0 no edge before, 1 one from
    another bucket, 2 one of this bucket that another row counts; r: whether the last node has an edge; body: hashes of edges and nodes, null from a task's third equal row on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = np.frombuffer(wanted.value, np.uint8), np.frombuffer(common.value, np.uint8)
        any_hot = bool(hot.any())
        met: set[bytes] = set()
        sent: dict[int, bool] = {}
        for batch in batches:
            for s in shards(batch, met, most):
                x = Nodes(s)
                node = rolled(x.words, NODE)
                keep = x.own & _in(bits, x.anchor)
                a = x.anchor
                if any_hot and (often := _in(hot, a)).any():
                    top = np.uint64((1 << 64) - 1)
                    rare = _least(np.where(_in(hot, x.gram), top, x.gram))
                    a = np.where(often, np.where(rare == top, node, rare), a)
                edge = rolled(x.words, WIDTH)
                new = keep.copy()
                new[1:] &= ~keep[:-1] | (a[1:] != a[:-1]) | (x.slice[1:] != x.slice[:-1])
                ends = keep.copy()
                ends[:-1] &= ~keep[1:] | new[1:]
                f, t = np.flatnonzero(new), np.flatnonzero(ends)
                own = x.slice[f]
                before = f > x.first[own]
                left = np.where(before, np.where(a[np.maximum(f - 1, 0)] == a[f], 2, 1), 0)
                right = t + WIDTH <= x.first[own + 1]
                e_raw, n_raw = edge.tobytes(), (node >> np.uint64(32)).astype(np.uint32).tobytes()
                a_raw = a[f].tobytes()
                keys, sid, body = [], [], []
                for i, (b, e, l, r, o) in enumerate(zip(f.tolist(), t.tolist(), left.tolist(), right.tolist(), own.tolist(), strict=True)):
                    data = e_raw[8 * (b - (l > 0)) : 8 * (e + r)] + n_raw[4 * b : 4 * e + 4]
                    d = int.from_bytes(hashlib.blake2b(data + bytes((l, r)) + a_raw[8 * i : 8 * i + 8], digest_size=8).digest(), "little", signed=True)
                    keys.append(s.keys[o])
                    sid.append(d)
                    twice = sent.get(d)
                    body.append(None if twice else data)
                    if not twice:
                        sent[d] = twice is not None
                at = f - x.first[own] + np.array(s.starts)[own]
                yield _fields({"a": pa.array(a[f].view(np.int64)), "sid": pa.array(sid, pa.int64()), "k": pa.array(keys, pa.binary()), "s": pa.array(at), "c": pa.array((t - f + 1).astype(np.int32)), "l": pa.array(left.astype(np.int32)), "r": pa.array(right.astype(np.int32)), "body": pa.array(body, pa.binary())})
        trim()

    return docs.select("text").mapInArrow(run, "a long, sid long, k binary, s long, c int, l int, r int, body binary")


def _chains(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, steps from it) of each element of chains given by their predecessors (-1: none); a cycle is cut at its smallest element."""
    n = len(prev)
    own = np.arange(n)

    def jump(up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, far, low = np.where(up < 0, own, up), (up >= 0).astype(np.int64), np.minimum(own, np.where(up < 0, own, up))
        for _ in range(max(1, int(n).bit_length()) + 1):
            nxt = up[up]
            if (nxt == up).all():
                break
            far, low, up = far + far[up], np.minimum(low, low[up]), nxt
        return up, far, low

    up, far, low = jump(prev)
    loose = prev[up] >= 0
    if loose.any():
        prev = np.where(loose & (low == own), -1, prev)
        up, far, _ = jump(prev)
    return up, far


def compact(a: np.ndarray, sid: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, body: np.ndarray, begin: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(pieces, spans) of whole buckets, rows by a and sid. ``body``: 32-bit words of all bodies, ``begin``: where each row's begin.

    pieces: p, up (has: whether there is one), n. spans: sid, off (edges from the row's first node on), n, p, at (place in the piece).
    """
    has = (left > 0).astype(np.int64)
    n_edges = has + c - 1 + right
    row = np.repeat(np.arange(len(a)), n_edges)
    first = np.cumsum(n_edges) - n_edges
    j = np.arange(len(row)) - first[row]
    at = begin[row] + 2 * j
    edge = body[at].astype(np.uint64) | body[at + 1].astype(np.uint64) << np.uint64(32)
    salt = mix64(a.view(np.uint64) + np.uint64(BASE))
    _, one, e = np.unique(mix64(edge ^ salt[row]), return_index=True, return_inverse=True)
    own = j >= has[row]
    often = np.bincount(e, weights=own | (left[row] == 1)) >= 2
    mine = np.bincount(e, weights=own) > 0
    # each node's repeated edges in and out: the same one each time, or several
    n_row = np.repeat(np.arange(len(a)), c)
    m = np.arange(len(n_row)) - np.repeat(np.cumsum(c) - c, c)
    node = body[begin[n_row] + 2 * n_edges[n_row] + m]
    _, v = np.unique(mix64(node.astype(np.uint64) ^ mix64(salt[n_row])), return_inverse=True)
    total = int(v.max()) + 1 if len(v) else 0
    sides = []
    for k, there in ((has[n_row] - 1 + m, None), (has[n_row] + m, None)):
        there = (k >= 0) & (k < n_edges[n_row])
        x, w = v[there], e[first[n_row[there]] + k[there]]
        x, w = x[often[w]], w[often[w]]
        lo, hi = np.full(total, len(one), np.int64), np.full(total, -1, np.int64)
        np.minimum.at(lo, x, w)
        np.maximum.at(hi, x, w)
        sides.append(np.where(lo == hi, lo, -1))
    into, out = sides
    linked = np.flatnonzero((into >= 0) & (out >= 0))
    into, out = into[linked], out[linked]
    prev, foreign = np.full(len(one), -1, np.int64), np.full(len(one), -1, np.int64)
    inside = mine[into]
    prev[out[inside]] = into[inside]
    foreign[out[~inside]] = into[~inside]
    real = np.flatnonzero(often & mine)
    number = np.full(len(one), -1, np.int64)
    number[real] = np.arange(len(real))
    back = prev[real]
    top, far = _chains(np.where(back >= 0, number[back], -1))
    by = np.lexsort((far, top))
    final = by[np.append(top[by][1:] != top[by][:-1], True)] if len(by) else by
    name = np.zeros(len(real), np.uint64)
    name[top[final]] = edge[one[real[final]]]
    up = foreign[real[top[final]]]
    pieces_ = {"p": name[top[final]], "up": np.where(up >= 0, edge[one[np.maximum(up, 0)]] if len(one) else np.uint64(0), np.uint64(0)), "has": up >= 0, "n": far[final] + 1}
    fresh = np.append(True, sid[1:] != sid[:-1])[: len(sid)]
    w = np.flatnonzero(own & fresh[row] & often[e])
    q = number[e[w]]
    begins = np.append(True, (row[w][1:] != row[w][:-1]) | (j[w][1:] != j[w][:-1] + 1) | (top[q][1:] != top[q][:-1]) | (far[q][1:] != far[q][:-1] + 1))[: len(w)]
    b = np.flatnonzero(begins)
    spans = {"sid": sid[row[w[b]]], "off": j[w[b]] - has[row[w[b]]], "n": np.diff(np.append(b, len(w))), "p": name[top[q[b]]], "at": far[q[b]]}
    return pieces_, spans


def _buckets(rows: DataFrame) -> DataFrame:
    """Pieces (sid null) and spans of all buckets."""

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda n: t[n].to_numpy()
        raw = t["body"].combine_chunks()
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        body = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32)
        got, spans = compact(col("a"), col("sid"), col("c").astype(np.int64), col("l"), col("r").astype(np.int64), body, (off[:-1] - off[0]) // 4)
        k, none = len(got["p"]), pa.nulls(len(got["p"]), pa.int64())
        yield _fields({"sid": none, "off": none, "n": pa.array(got["n"], pa.int64()), "p": pa.array(got["p"].view(np.int64)), "at": none, "up": pa.array(got["up"].view(np.int64), mask=~got["has"]) if k else none})
        yield _fields({"sid": pa.array(spans["sid"], pa.int64()), "off": pa.array(spans["off"], pa.int64()), "n": pa.array(spans["n"], pa.int64()), "p": pa.array(spans["p"].view(np.int64)), "at": pa.array(spans["at"], pa.int64()), "up": pa.nulls(len(spans["sid"]), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 8192:
                continue
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if cut:
                yield from flush(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
            size = table.num_rows - cut
        if size:
            yield from flush(pa.Table.from_batches(held).combine_chunks())
        trim()

    dealt = rows.filter("body is not null").select("a", "sid", "c", "l", "r", "body").repartition("a").sortWithinPartitions("a", "sid")
    return dealt.mapInArrow(run, "sid long, off long, n long, p long, at long, up long")


def paths(links: DataFrame) -> DataFrame:
    """(p, path, base) of pieces (p, up, n): the first piece of its path and the edges of the path before it. Rows' jumps double; cycles are cut at the smallest p."""
    first = saved(links.select("p", "up", "n", F.col("n").alias("sum"), F.col("p").alias("path"), F.col("p").alias("low")))
    done, active, before = [first.filter("up is null")], first.filter("up is not null"), -1
    while (left := active.count()) > 0:
        if left == before:
            # each round ends some piece of every path that is left, so only cycles are
            cut = active.filter("low = p").select("p", F.lit(True).alias("cut"))
            again = links.join(active.select("p"), "p").join(cut, "p", "left").select("p", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "n")
            return _all(done).select("p", "path", (F.col("sum") - F.col("n")).alias("base")).unionByName(paths(again))
        level = _all([*done, active])
        over = level.select(F.col("p").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("s2"), F.col("path").alias("path2"), F.col("low").alias("low2"))
        step = saved(active.join(over, "up", "left").select("p", F.col("up2").alias("up"), "n", (F.col("sum") + F.coalesce("s2", F.lit(0))).alias("sum"), F.coalesce("path2", "path").alias("path"), F.least("low", "low2").alias("low")))
        done.append(step.filter("up is null"))
        active, before = step.filter("up is not null"), left
    return _all(done).select("p", "path", (F.col("sum") - F.col("n")).alias("base"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _walks(visits: DataFrame) -> DataFrame:
    """Visits of one text that go on along a path are one; a visit that stands twice (from equal texts in different tasks) counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("k").to_pylist()
            s, n, path, at = (batch.column(c).to_numpy() for c in ("s", "n", "path", "at"))
            if held is not None:
                keys = [held[0], *keys]
                s, n, path, at = (np.append(x, y) for x, y in zip(held[1:], (s, n, path, at), strict=True))
            k = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            same = (k[1:] == k[:-1]).all(axis=1) & (path[1:] == path[:-1])
            twin = np.append(False, same & (s[1:] == s[:-1]) & (n[1:] == n[:-1]) & (at[1:] == at[:-1]))
            live = np.flatnonzero(~twin)
            s, n, path, at, k = s[live], n[live], path[live], at[live], k[live]
            on = (k[1:] == k[:-1]).all(axis=1) & (path[1:] == path[:-1]) & (s[1:] == s[:-1] + n[:-1]) & (at[1:] == at[:-1] + n[:-1])
            first = np.flatnonzero(np.append(True, ~on))
            last = np.append(first[1:], len(s)) - 1
            size = s[last] + n[last] - s[first]
            # the last walk may go on; what is held is its last visit if later visits can be its twins
            out = slice(0, len(first) - 1)
            f = first[out]
            yield _fields({"k": pa.array([keys[live[i]] for i in f.tolist()], pa.binary()), "s": pa.array(s[f]), "n": pa.array(size[out]), "path": pa.array(path[f]), "at": pa.array(at[f])})
            f = first[-1]
            if last[-1] > f:  # all but its last visit
                g = last[-1]
                yield _fields({"k": pa.array([keys[live[f]]], pa.binary()), "s": pa.array(s[f : f + 1]), "n": pa.array(s[g : g + 1] - s[f]), "path": pa.array(path[f : f + 1]), "at": pa.array(at[f : f + 1])})
                f = g
            held = (keys[live[f]], s[f], n[f], path[f], at[f])
        if held is not None:
            yield _fields({"k": pa.array([held[0]], pa.binary()), **{c: pa.array([int(x)], pa.int64()) for c, x in zip(("s", "n", "path", "at"), held[1:], strict=True)}})

    return visits.repartition("k").sortWithinPartitions("k", "s", "path", "at", "n").mapInArrow(run, "k binary, s long, n long, path long, at long")


def sources(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> DataFrame:
    """(k, s, n, path, at): the walks of texts (by their words' digest) along compacted paths of repeated edges: first word, edges, path, place in the path."""
    spark = tuned(docs.sparkSession)
    counted = saved(anchors(docs, most).filter("n > 1"))
    bits = min(MOST_BITS, max(20, int(np.ceil(np.log2(max(1, counted.count()) * 16)))))
    hot = counted.filter(F.col("n") > group)
    hot_bits = min(MOST_BITS, max(13, int(np.ceil(np.log2(max(1, hot.count()) * 64)))))
    wanted = spark.sparkContext.broadcast(_bitmap(counted.select("b"), bits))
    common = spark.sparkContext.broadcast(_bitmap(hot.select("b"), max(15, hot_bits)))
    rows = saved(_segments(docs, wanted, common, most))
    made = saved(_buckets(rows))
    whole = saved(paths(made.filter("sid is null").select("p", "up", "n")))
    spans = made.filter("sid is not null").select("sid", "off", "n", "p", "at").join(whole, "p").groupBy("sid").agg(F.collect_list(F.struct("off", "n", "path", (F.col("at") + F.col("base")).alias("at"))).alias("spans"))
    table = saved(spans.join(rows.groupBy("sid").agg(F.count(F.lit(1)).alias("rows")), "sid"))
    found = lookup(rows.select("sid", "k", "s"), table, "sid", "rows").filter("spans is not null").select("k", "s", F.explode("spans").alias("x"))
    return saved(_walks(found.select("k", (F.col("s") + F.col("x.off")).alias("s"), "x.n", "x.path", "x.at")))


def spans(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> DataFrame:
    """(k, start, end): maximal runs of words that repeated windows cover, in texts with digest k of their words."""
    walks = sources(docs, group, most)
    marks = walks.select("path", F.explode(F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("by"), F.lit(1).alias("rows")), F.struct((F.col("at") + F.col("n")).alias("at"), F.lit(-1).alias("by"), F.lit(0).alias("rows")))).alias("m"))
    marks = marks.groupBy("path", "m.at").agg(F.sum("m.by").alias("by"), F.sum("m.rows").alias("rows"))
    w = Window.partitionBy("path").orderBy("at")
    over = marks.select("path", "at", "rows", F.sum("by").over(w).alias("cover"), F.lead("at").over(w).alias("to"))
    gaps = F.sum(F.when(F.col("cover") < 2, 1).otherwise(0)).over(w)
    parts = over.withColumn("gap", gaps).groupBy("path", "gap").agg(F.min(F.when(F.col("cover") >= 2, F.col("at"))).alias("a"), F.max(F.when(F.col("cover") >= 2, F.col("to"))).alias("b"), F.sum("rows").alias("rows"))
    table = saved(parts.groupBy("path").agg(F.sum("rows").alias("rows"), F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("good")))
    cut = lookup(walks, table, "path", "rows").select("k", "s", "n", "at", F.explode("good").alias("g"))
    a, b = F.greatest("at", "g.a"), F.least(F.col("at") + F.col("n"), F.col("g.b"))
    return joined_spans(cut.filter(a < b).select("k", (F.col("s") + a - F.col("at")).alias("start"), (F.col("s") + b - F.col("at") + NODE).alias("end")))


def _kept(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(k, n_removed, kept): the texts that lose words, once each; a bitmap spares most others the shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(edits.select(F.conv(F.hex(F.substring("k", 1, 3)), 16, 10).cast("long").alias("b")), 24))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        met: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch):
                keys, texts = [], []
                for t in map(_plain, part.column("text").to_pylist()):
                    if t.count(b" ") >= WIDTH - 1:
                        k = _key(t)
                        b = int.from_bytes(k[:3], "big")
                        if bits[b >> 3] >> (b & 7) & 1 and k not in met:
                            met.add(k)
                            keys.append(k)
                            texts.append(t)
                yield _fields({"k": pa.array(keys, pa.binary()), "raw": pa.array(texts, pa.binary())})
        trim()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for raw, runs in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                own, stay, at, n = raw.split(b" "), [], 0, 0
                for r in runs:
                    stay.extend(own[at : r["start"]])
                    n += r["end"] - r["start"]
                    at = r["end"]
                stay.extend(own[at:])
                removed.append(n)
                kept.append(b" ".join(stay))
            yield _fields({"k": batch.column("k"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    raws = docs.select("text").mapInArrow(keyed, "k binary, raw binary").dropDuplicates(["k"])
    return raws.join(edits, "k").mapInArrow(cut, "k binary, n_removed long, kept string")


def deduplicated(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(rows, edits): each row of ``docs`` without its text, with n_words, k and d (digests of its words); and k, rows, n_removed and kept (words joined by one space) of texts that lose words."""
    tuned(docs.sparkSession)

    def digests(texts: pa.Array) -> list[pa.Array]:
        plain = [_plain(t) for t in texts.to_pylist()]
        full = [hashlib.sha256(t) for t in plain]
        return [pa.array([t.count(b" ") + 1 if t else 0 for t in plain], pa.int64()), pa.array([x.digest()[:16] for x in full], pa.binary()), pa.array([x.hexdigest() for x in full], pa.string())]

    rows = saved(map_texts(docs, digests, "n_words long, k binary, d string"))
    merged = saved(spans(docs, group, most).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    copies = rows.filter(F.col("n_words") >= WIDTH).groupBy("k", "n_words").agg(F.count(F.lit(1)).alias("rows"))
    # a text that stands twice goes entirely
    done = _kept(docs, merged).join(copies.select("k", "rows"), "k").filter("rows = 1").select("k", "rows", "n_removed", "kept")
    return rows, saved(done.unionByName(copies.filter("rows > 1").select("k", "rows", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))))


def report(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> DataFrame:
    """The digest columns of the contract."""
    rows, edits = deduplicated(docs.select("doc_id", "text"), group, most)
    table = saved(edits.select("k", "rows", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    long = lookup(rows.filter(F.col("n_words") >= WIDTH), table, "k", "rows").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "d").alias("kept_sha256"))
    short = rows.filter(F.col("n_words") < WIDTH).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("d").alias("kept_sha256"))
    return long.unionByName(short)
