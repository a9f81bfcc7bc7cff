"""Similarity join on word shingles by a blocked sparse product of documents and shingles.

Two documents link when 100 x |A and B| >= ``num`` x |A or B| on their sets of shingles of ``size`` words: 85 and 4 unless
the caller asks for others (``num`` above 50). Rows with equal sets are one node.

The incidence of nodes and shingles is dealt by columns (shingles), a block of columns to a task. In one common order of
shingles a node needs only its first p(n) = n - ceil(num n / 100) + 1 columns: linked nodes share one of them at least. Inside a
block the product of the incidence with its transpose accumulates overlaps of all pairs whose sizes fit; blocks' overlaps
are added up by pair. Shingles shared beyond these columns are at most max(n - p(n)) of the two, so pairs whose overlap falls short
of the bound on the sizes by more than that go, and pairs whose parity bits differ in more places than linked sets may. What is left is
counted over all columns (``verified``). The order puts
frequent shingles last; which are frequent says a count of all shingles in 2^22 buckets, whose bits (512 KB) every task gets.

A column of over ``WIDE`` nodes does not emit its pairs: each node is held against the one before it and the last head before it (a
node whose digest ends in six zero bits), components of these links are found, and what then still lies in different
components of one such column is compared in full: nodes outside the column's largest component with all of it, in blocks of
at most ``BLOCK`` nodes. That check is complete, so no link between components is lost. Columns in buckets of over ``HOT`` shingles
are split by salts before they are sorted, so that no task gets a third of all rows; the salts' first and last nodes meet once more.

Cases: null texts and texts without words have n_shingles 0, link with nothing and are their own component; a text of
fewer words than a shingle has one shingle of all of them; ties and repeated rows share a component; a component's id is its smallest
doc_id; an empty table gives an empty result. ``join`` takes doc_id and text only, whatever other columns there are;
``representatives`` keeps all columns, whatever their names. Texts are taken whole; of a long one a task holds its shingles (8 bytes a word).
Shingles are 64-bit hashes, sets are compared by all of them, equal sets are found by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import free, lookup, map_texts, mix64, pieces, saved, text_buffers, tuned
from covertile.llm.words import SOLID, shingles, words

SIZE, NUM, DEN = 4, 85, 100
BUCKETS, CHUNK = 1 << 22, 1 << 16
#: Nodes of a column from which on it is wide, and shingles of a bucket from which on its columns are split.
WIDE, HOT = 8, 1 << 13
BLOCK = 1024


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    raw, offsets = text_buffers(texts)
    _, _, doc, h = words(raw, offsets, SOLID)
    d, s = shingles(h, doc, size)
    order = np.argsort(d, kind="stable")
    d, s = d[order], s[order]
    cuts = np.searchsorted(d, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = np.sort(s[a:b])
        if b - a > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
    return out


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def parities(own: np.ndarray) -> bytes:
    """For each of about n buckets whether the set has an odd number of shingles in it.

    The bits that differ between two sets' parities are at most the shingles that only one of them has.
    """
    b = 1 << min(16, max(6, int(len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def nodes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without its text, with n (the set's size), k (its digest) and bits (its parities)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        own = sets(texts, size)
        return [pa.array([len(x) for x in own], pa.int64()), pa.array([_digest(x) for x in own], pa.binary()), pa.array([parities(x) for x in own], pa.binary())]

    return map_texts(docs, run, "n long, k binary, bits binary")


def _most(total, num: int = NUM):
    """The most shingles that only one of two linked sets has, by the sum of their sizes."""
    return total - 2 * -(-num * total // (num + DEN))


def _differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def near(pairs: DataFrame, known: DataFrame, num: int = NUM) -> DataFrame:
    """The ``pairs`` (a, k) whose parities (``known``: k, n, bits) don't rule a link out. Some 100 bytes a set travel, not its shingles."""
    left = known.select(F.col("k").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("n", "bits", "an", "abits")]
            keep = [_differ(y, z) <= _most(x + w, num) for x, y, w, z in zip(*cols, strict=True)]
            yield batch.select(["a", "k"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(known, "k").mapInArrow(run, "a binary, k binary")


def _once(docs: DataFrame, size: int, kernel: Callable[[bytes, np.ndarray], tuple | None], fields: str) -> DataFrame:
    """Rows that ``kernel`` makes of (digest, set); a set that a task has met is passed over."""
    types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    spec = [f.strip().split(" ") for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch):
                got: list[list] = [[] for _ in spec]
                for own in sets(part.column("text"), size):
                    k = _digest(own)
                    if not len(own) or k in met:
                        continue
                    met.add(k)
                    row = kernel(k, own)
                    if row is not None:
                        for at, x in zip(got, row, strict=True):
                            at.append(x)
                if got[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if isinstance(x[0], np.ndarray) else list(chain.from_iterable(x)) if isinstance(x[0], list) else x, types[t]) for x, (_, t) in zip(got, spec, strict=True)], names=[n for n, _ in spec])

    return docs.select("text").mapInArrow(run, fields)


def frequent_bits(docs: DataFrame, size: int = SIZE, hot: int = HOT, factor: int = 4, least: int = 32) -> tuple[bytes, bytes]:
    """Bits for each bucket of shingles: whether it holds over ``factor`` x the mean and at least ``least`` occurrences; and over ``hot``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.uint16)
        for batch in batches:
            for part in pieces(batch):
                own = sets(part.column("text"), size)
                if own:
                    more = np.bincount((np.concatenate(own) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    held = np.minimum(held + more, 65535).astype(np.uint16)
        for c in range(BUCKETS // CHUNK):
            raw = held[c * CHUNK : (c + 1) * CHUNK].tobytes()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held.setdefault(c, np.zeros(CHUNK, np.int64))
                held[c] += np.frombuffer(pa.decompress(raw, decompressed_size=2 * CHUNK, codec="zstd", asbytes=True), np.uint16)
        for c, x in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "n": pa.array([int(x.sum())]), "counts": pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    counted = saved(docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(total, "chunk int, n long, counts binary"))
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    limit = max(least, int(factor * mean))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(raw, np.int32)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "many": pa.array([np.packbits(n > limit).tobytes()], pa.binary()), "hot": pa.array([np.packbits(n > hot).tobytes()], pa.binary())})

    out = np.zeros((2, BUCKETS // 8), np.uint8)
    for c, *both in counted.mapInArrow(bits, "chunk int, many binary, hot binary").collect():  # 64 rows of 8 KB each
        for at, raw in zip(out, both, strict=True):
            at[c * CHUNK // 8 : (c + 1) * CHUNK // 8] = np.frombuffer(raw, np.uint8)
    return out[0].tobytes(), out[1].tobytes()


def _set_in(bits: bytes, at: np.ndarray) -> np.ndarray:
    return ((np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def columns(docs: DataFrame, known, salts: int, size: int = SIZE, num: int = NUM) -> DataFrame:
    """(s, salt, k, n): the entries of each node in the columns that come first for it; ``known`` are the broadcast bits."""

    def run(k: bytes, own: np.ndarray) -> tuple:
        many, hot = known.value
        at = (own & np.uint64(BUCKETS - 1)).astype(np.int64)
        late = _set_in(many, at)
        n = len(own)
        order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[: n - (num * n + DEN - 1) // DEN + 1]
        salt = np.where(_set_in(hot, at[order]), 1 + int.from_bytes(k[8:16], "big") % salts, 0)
        return own[order].view(np.int64), salt.astype(np.int32), [k] * len(order), np.full(len(order), n, np.int32)

    return _once(docs, size, run, "s long, salt int, k binary, n int")


PAIRED = "kind int, s long, a binary, k binary, an int, kn int, c int"


def _product(s: np.ndarray, salt: np.ndarray, n: np.ndarray, k: np.ndarray, num: int, most: int) -> pa.RecordBatch:
    """Rows of ``paired`` for whole columns, in order of (s, salt, n, k); k has two 64-bit halves."""
    same = np.append(False, (s[1:] == s[:-1]) & (salt[1:] == salt[:-1]))
    # a set that several tasks met stands there more than once
    keep = ~(same & np.append(False, (k[1:] == k[:-1]).all(axis=1)))
    s, salt, n, k = s[keep], salt[keep], n[keep].astype(np.int64), k[keep]
    same = np.append(False, (s[1:] == s[:-1]) & (salt[1:] == salt[:-1]))
    # in order of sizes a column falls apart where the next size is too large for the one before, and nothing links across
    near = np.append(False, n[:-1] * DEN >= n[1:] * num)
    first = np.flatnonzero(~same | ((salt == 0) & ~near))
    size = np.diff(np.append(first, len(s)))
    of = np.repeat(np.arange(len(first)), size)
    pos = np.arange(len(s)) - first[of]
    wide = ((size > most) | (salt[first] > 0))[of]
    left, right = [], []
    at = np.flatnonzero(~wide & (size[of] > 1))
    for lag in range(1, most):
        at = at[pos[at] + lag < size[of[at]]]
        if not len(at):
            break
        fits = n[at] * DEN >= n[at + lag] * num
        left.append(at[fits])
        right.append(at[fits] + lag)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    # a number for each node of the block, so that a pair is one number
    order = np.lexsort((k[:, 1], k[:, 0]))
    node = np.empty(len(s), np.int64)
    node[order] = np.cumsum(np.append(0, (k[order][1:] != k[order][:-1]).any(axis=1))) if len(s) else []
    _, one, count = np.unique(node[i] * len(s) + node[j], return_index=True, return_counts=True)
    i, j = i[one], j[one]
    head = ((k[:, 1] & np.uint64(63)) == 0) | (pos == 0)
    top = ((k[:, 1] & np.uint64(4095)) == 0) | (pos == 0)
    place = np.arange(len(s))
    lower, upper = (np.maximum.accumulate(np.where(x, place, 0)) if len(s) else place for x in (head, top))
    w = np.flatnonzero(wide & (pos > 0))
    x, y = np.concatenate([w - 1, np.where(head[w], upper[w - 1], lower[w - 1])]), np.concatenate([w, w])
    fits = n[x] * DEN >= n[y] * num
    x, y = x[fits], y[fits]
    _, one = np.unique(node[x] * len(s) + node[y], return_index=True)
    x, y = x[one], y[one]
    all_wide = np.flatnonzero(wide & ((salt > 0) | (size[of] > 1)))
    salted = salt[first] > 0
    ends = np.unique(np.concatenate([first[salted], first[salted] + size[salted] - 1]))
    a, b = np.concatenate([i, x, all_wide, ends]), np.concatenate([j, y, all_wide, ends])
    # a wide column is named by its shingle and, if it is whole, its stretch of sizes
    name = mix64(s.view(np.uint64) ^ (np.where(salt > 0, 0, n[first[of]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    kinds = [len(i) + len(x), len(all_wide), len(ends)]
    names = np.concatenate([np.zeros(kinds[0], np.int64), name[all_wide], s[ends]])
    digest = pa.array([x.tobytes() for x in k.astype(">u8")], pa.binary()) if len(s) else pa.array([], pa.binary())
    c = np.concatenate([count, np.zeros(len(a) - len(i), np.int64)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1, 2], kinds).astype(np.int32)), pa.array(names), digest.take(pa.array(a)), digest.take(pa.array(b)), pa.array(n[a].astype(np.int32)), pa.array(n[b].astype(np.int32)), pa.array(c.astype(np.int32))],
        names=["kind", "s", "a", "k", "an", "kn", "c"],
    )


def paired(entries: DataFrame, num: int = NUM, wide: int = WIDE) -> DataFrame:
    """The product's rows (kind, s, a, k, an, kn, c) of a block of columns in each task.

    kind 0: a pair of nodes with the overlap c that this block saw; kind 1: a node k of a wide column s; kind 2: a first or last
    node of a salt of column s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            s, salt, n = (batch.column(c).to_numpy() for c in ("s", "salt", "n"))
            k = np.frombuffer(b"".join(batch.column("k").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            held.append((s, salt, n, k))
            if sum(len(x[0]) for x in held) < 1 << 16:
                continue
            s, salt, n, k = joined()
            cut = int(np.argmax((s == s[-1]) & (salt == salt[-1])))  # the last column may go on
            held = [(s[cut:], salt[cut:], n[cut:], k[cut:])]
            if cut:
                yield _product(s[:cut], salt[:cut], n[:cut], k[:cut], num, wide)
        if held:
            yield _product(*joined(), num, wide)

    dealt = entries.repartition("s", "salt").sortWithinPartitions("s", "salt", "n", "k")
    return dealt.select("s", "salt", "n", "k").mapInArrow(run, PAIRED)


def candidates(product: DataFrame, num: int = NUM) -> DataFrame:
    """(a, k) of the pairs in ``product`` whose overlap so far does not rule a link out.

    A pair may also share each wide column that both are in, and max(n - p(n)) shingles beyond the first columns.
    """
    pairs = product.filter("kind = 0").groupBy("a", "k").agg(F.sum("c").alias("c"), F.first("an").alias("an"), F.first("kn").alias("kn"))
    wide = product.filter("kind = 1").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    pairs = pairs.join(wide.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a", "left").join(wide, "k", "left")
    more = F.least(F.coalesce("wa", F.lit(0)), F.coalesce("w", F.lit(0)))
    beyond = F.ceil(F.greatest("an", "kn") * F.lit(num) / F.lit(float(DEN)) - 1e-9) - 1
    least = F.ceil((F.col("an") + F.col("kn")) * F.lit(num) / F.lit(float(num + DEN)) - 1e-9)
    return pairs.filter(F.col("c") + more + beyond >= least).select("a", "k")


def bitmap_of(keys: DataFrame) -> bytes:
    """2^24 bits over the first 24 bits of the digests ``k``."""
    bit = F.conv(F.hex(F.substring("k", 1, 3)), 16, 10).cast("long")
    maps = keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 32768).alias("c")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits"))
    held = np.zeros(1 << 21, np.uint8)
    for c, bits in maps.collect():  # 512 rows of 4 KB at most
        held[c * 4096 : (c + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return held.tobytes()


def _marked(bits: bytes, k: bytes) -> int:
    b = int.from_bytes(k[:3], "big")
    return bits[b >> 3] >> (b & 7) & 1


def wanted(docs: DataFrame, keys: DataFrame, size: int, what: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(k, items): ``what`` of the sets of ``keys``, once each. A bitmap spares most others; the join then decides."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys))
    found = _once(docs, size, lambda k, own: (k, what(own)) if _marked(sent.value, k) else None, "k binary, items binary")
    return found.join(keys, "k", "left_semi").dropDuplicates(["k"])


def verified(pairs: DataFrame, items: DataFrame, num: int = NUM) -> DataFrame:
    """The links among ``pairs`` (a, k): a row of the product for each a, over all columns, at the places of its pairs."""
    members = pairs.join(items, "k").select("a", F.lit(1).alias("kind"), "k", "items")
    heads = items.join(pairs.select(F.col("a").alias("k")).distinct(), "k", "left_semi").select(F.col("k").alias("a"), F.lit(0).alias("kind"), "k", "items")
    rows = members.unionByName(heads).repartition("a").sortWithinPartitions("a", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, kind, k, raw = (batch.column(c).to_pylist() for c in ("a", "kind", "k", "items"))
            out: list[tuple[bytes, bytes]] = []
            i = 0
            while i < len(a):
                if kind[i] == 0:
                    head, own = a[i], np.frombuffer(raw[i], np.uint64)
                    i += 1
                    continue
                j = i
                while j < len(a) and kind[j] == 1 and a[j] == a[i]:
                    j += 1
                if head == a[i]:
                    sizes = np.array([len(x) // 8 for x in raw[i:j]])
                    flat = np.frombuffer(b"".join(raw[i:j]), np.uint64)
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                    good = DEN * both >= num * (len(own) + sizes - both)
                    out += [(head, k[i + x]) for x in np.flatnonzero(good).tolist()]
                i = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["a", "k"])

    return rows.select("a", "kind", "k", "items").mapInArrow(run, "a binary, k binary")


def components(links: DataFrame) -> DataFrame:
    """(k, c) of every node of ``links`` (a, k): c is the smallest node that it reaches.

    Labels fall to the smallest neighbour's, then to their label's own label, until none changes; each round is a table.
    """
    both = saved(links.select("a", "k").unionByName(links.select(F.col("k").alias("a"), F.col("a").alias("k"))).distinct())
    label = saved(both.groupBy("k").agg(F.min("a").alias("m")).select("k", F.least("k", "m").alias("c")))
    while True:
        near = both.join(label.select(F.col("k").alias("a"), F.col("c").alias("ca")), "a").groupBy("k").agg(F.min("ca").alias("m"))
        low = label.join(near, "k", "left").select("k", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = label.select(F.col("k").alias("c"), F.col("c").alias("cc"))
        now = saved(low.join(jump, "c", "left").select("k", "was", F.least("c", F.coalesce("cc", "c")).alias("c")))
        if now.filter("c <> was").isEmpty():
            return now.select("k", "c")
        label = now.select("k", "c")


def _block_links(rows: list[tuple[bytes, bytes, int, int, np.ndarray]], num: int = NUM) -> list[tuple[bytes, bytes]]:
    """Links between different components among the rows (k, component, side, n, set) of one block pair.

    The product of a side's incidence with the other's, over shingles that two rows share, some thousand columns at a time.
    """
    rows = sorted(rows, key=lambda r: r[3])
    n = np.array([r[3] for r in rows])
    comp = np.unique([r[1] for r in rows], return_inverse=True)[1].ravel()
    side = np.array([r[2] for r in rows])
    item = np.concatenate([r[4] for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    u, at, count = np.unique(item, return_inverse=True, return_counts=True)
    shared = count > 1
    code = np.cumsum(shared) - 1
    keep = shared[at]
    row, col = row[keep], code[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(rows), len(rows)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(rows), 4096), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        overlap += m @ m.T
    total = n[:, None] + n[None, :] - overlap
    ok = (DEN * overlap >= num * total) & (comp[:, None] != comp[None, :])
    if side.max() != side.min():
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    # one link for each pair of components is enough
    _, first = np.unique(np.minimum(comp[i], comp[j]) * len(rows) + np.maximum(comp[i], comp[j]), return_index=True)
    return [(rows[i[f]][0], rows[j[f]][0]) for f in first]


def _block_near(n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: list[bytes], num: int = NUM) -> list[tuple[int, int]]:
    """Pairs of rows of different sides and components that parities don't rule out, as a forest: not all pairs."""
    up = list(range(len(n)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)  # sizes that fit lie in one or the next
        words = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)
        if len(twice):
            more = np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), 2, -1)
            words = np.concatenate([words, more[:, 0] ^ more[:, 1]])
        both = np.concatenate([own, twice])
        for i in range(0, len(own), 256):
            a = own[i : i + 256]
            total = n[a][:, None] + n[both][None, :]
            ok = (comp[a][:, None] != comp[both][None, :]) & (DEN * np.minimum(n[a][:, None], n[both][None, :]) >= num * np.maximum(n[a][:, None], n[both][None, :]))
            ok &= side[a][:, None] != side[both][None, :]
            x, y = np.nonzero(ok)
            for z in range(0, len(x), 1 << 16):
                xs, ys = x[z : z + (1 << 16)], y[z : z + (1 << 16)]
                good = np.bitwise_count(words[i + xs] ^ words[ys]).sum(axis=1, dtype=np.int64) <= _most(total[xs, ys], num)
                for p, q in zip(a[xs[good]].tolist(), both[ys[good]].tolist(), strict=True):
                    r, t = find(p), find(q)
                    if r != t:
                        up[r] = t
                        out.append((p, q))
    return out


def _by_block(rows: DataFrame, payload: str, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` on the rows (s, i, j, side, k, c, n, payload) of each block pair; one pair is held at a time."""
    dealt = rows.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").select("s", "i", "j", "side", "k", "c", "n", payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("s", "i", "j", "side", "k", "c", "n", payload)), strict=True):
                if row[:3] != at:
                    if len({r[5] for r in held}) > 1:
                        yield from kernel(held)
                    at, held = row[:3], []
                held.append(row)
        if len({r[5] for r in held}) > 1:
            yield from kernel(held)

    return dealt.mapInArrow(run, schema)


def remaining(wide: DataFrame, label: DataFrame, known: DataFrame, docs: DataFrame, size: int, num: int = NUM, block: int = BLOCK) -> DataFrame | None:
    """Links (a, k) between different components that share a wide column (s, k, n); None if no column has several.

    What lies outside a column's largest component is held against all of the column, block by block. Parities are compared
    first; only the sets of rows that still have a partner are multiplied.
    """
    rows = wide.join(label, "k", "left").select("s", "k", "n", F.coalesce("c", "k").alias("c"))
    each = rows.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))
    group = saved(each.groupBy("s").agg(F.sum("m").alias("size"), F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("s", "size", "main"))
    if group.isEmpty():
        return None
    rows = saved(rows.join(group, "s").withColumn("nb", F.ceil(F.col("size") / block).cast("int")))
    own = rows.select("s", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "k", "c", "n")
    asked = rows.filter("c <> main").select("s", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "k", "c", "n")

    def sift(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        side = np.array([r[3] for r in held])
        if side.min() == side.max():
            return
        comp = np.unique([r[5] for r in held], return_inverse=True)[1].ravel()
        out = _block_near(np.array([r[6] for r in held]), comp, side, [r[7] for r in held], num)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][4] for i, _ in out], pa.binary()), pa.array([held[j][4] for _, j in out], pa.binary())], names=["a", "k"])

    def multiply(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = _block_links([(r[4], r[5], r[3], r[6], np.frombuffer(r[7], np.uint64)) for r in held], num)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["a", "k"])

    bits = saved(known.join(rows.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]))
    forest = saved(_by_block(own.unionByName(asked).join(bits, "k"), "bits", sift, "a binary, k binary"))
    if forest.isEmpty():
        return None
    # what may link lies in one cluster of the forest, so each set goes to one place, whatever columns it shares
    cluster = components(forest).select("k", F.xxhash64("c").alias("s"))
    known = rows.select("k", "n", "c").dropDuplicates(["k"])
    members = saved(cluster.join(known, "k").select("s", "k", "n", "c"))
    sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("size"))
    items = saved(wanted(docs, members.select("k"), size, np.ndarray.tobytes))
    return _by_block(_dealt(members.join(sizes, "s"), block).join(items, "k"), "items", multiply, "a binary, k binary")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (s, size, k, c, n) dealt to pairs of blocks (i, j) of their group; a group of one block has one pair."""
    rows = rows.withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.select("s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "k", "c", "n")


def _named(docs: DataFrame, size: int, num: int, wide: int = WIDE, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``docs`` (doc_id, text), and (k, d, copies, c): each set's smallest doc_id, number of rows and component."""
    spark = tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = saved(nodes(docs, size))
    known = spark.sparkContext.broadcast(frequent_bits(docs, size, hot))
    salts = max(16, base.count() >> 16)
    product = saved(paired(columns(docs, known, salts, size, num), num, wide))
    ends = product.filter("kind = 2").select("s", F.lit(0).alias("salt"), "k", F.col("kn").alias("n"))
    again = paired(ends, num, wide).filter("kind = 0").withColumn("c", F.lit(0))
    pairs = saved(candidates(product.filter("kind < 2").unionByName(again), num))
    both = pairs.select("k").unionByName(pairs.select(F.col("a").alias("k"))).distinct()
    pairs = saved(near(pairs, saved(base.select("k", "n", "bits").join(both, "k", "left_semi").dropDuplicates(["k"])), num))
    items = saved(wanted(docs, saved(pairs.select("k").unionByName(pairs.select(F.col("a").alias("k"))).distinct()), size, np.ndarray.tobytes))
    links = saved(verified(pairs, items, num))
    label = components(links)
    rest = product.filter("kind = 1").select("s", "k", F.col("kn").alias("n"))
    more = None if rest.isEmpty() else remaining(rest, label, base.select("k", "bits"), docs, size, num, block)
    if more is not None:
        label = components(links.unionByName(saved(more)))
    first = base.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("copies"))
    return base, saved(first.join(label, "k", "left").select("k", "d", "copies", F.coalesce("c", "k").alias("c")))


def join(docs: DataFrame, size: int = SIZE, num: int = NUM, wide: int = WIDE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    base, named = _named(docs, size, num, wide, hot, block)
    least = saved(named.groupBy("c").agg(F.min("d").alias("component_id"), F.count(F.lit(1)).alias("parts")))
    of = saved(lookup(named, least, "c", "parts").select("k", "component_id", "copies"))
    out = lookup(base, of, "k", "copies")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE, num: int = NUM) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id (null ones last), then smallest set digest, then one row of those.

    A doc_id doesn't name a row: rows with a null doc_id take part by their texts, and different texts under one doc_id stay or go
    each by its own component. Texts without words link with nothing: one row of each doc_id stays, and all whose doc_id is null.
    A bitmap of the sets that are not alone spares the other texts the shuffle.
    """
    base, named = _named(docs, size, num)
    key, own, best, row = (free(docs.columns, x) for x in ("_k", "_d", "_b", "_row"))
    chosen = named.groupBy("c").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k")).alias("b"), F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("parts"))
    chosen = saved(chosen)
    crowded = saved(lookup(named, chosen.select("c", "rows", "parts"), "c", "parts").filter("rows > 1").select("k"))
    bare = base.filter("n = 0 and doc_id is not null").select("doc_id", "k").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(crowded.unionByName(bare.select("k"))))
    chosen = saved(chosen.filter("rows > 1").select(F.col("b.d").alias(own), F.col("b.k").alias(best)).unionByName(bare.select(F.col("doc_id").alias(own), F.col("k").alias(best))))
    few = saved(named.join(crowded, "k", "left_anti").select(F.col("d").alias(own), F.col("k").alias(best)))
    # what holds no word and has no doc_id has no key to be chosen by
    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def keys(texts: pa.Array) -> list[pa.Array]:
        k = [_digest(x) for x in sets(texts, size)]
        return [pa.array([x if _marked(sent.value, x) else None for x in k], pa.binary())]

    rows = map_texts(docs.filter(~loose), keys, f"{key} binary", keep_text=True).select(*docs.columns, key)
    met = rows.filter(F.col(key).isNotNull())
    whole = F.struct(*docs.columns)
    one = met.groupBy("doc_id", key).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*", key)
    kept = one.join(chosen.unionByName(few), F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(best)), "left_semi")
    alone = rows.filter(F.col(key).isNull())
    return kept.select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(docs.filter(loose))
