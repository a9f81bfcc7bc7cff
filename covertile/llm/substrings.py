"""Exact substring deduplication with suffix arrays by linear grouping.

Every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere goes, wherever the other is.

Each string of WIDTH bytes has an anchor, the ``GRAM`` bytes in it with the least hash (the leftmost of equal ones), which
depends on its bytes only. So strings are equal only if their anchors and their places around them are. Runs of strings that
share an anchor form a segment; a text is the sequence of its segments. Anchors that occur once anywhere are passed over
(a count of all anchors, sent back as a bitmap of bounded size). The segments of the others are dealt by anchor, and a
suffix array over them, a token for each (anchor, segment), is built by linear grouping (``gsaca``): equal neighbours are repeated
whole; a range of one anchor with different segments is compared string by string. Anchors with very many segments are dealt
by string instead, so that no task gets an unbounded group.

Sorting tokens of some 250 bytes instead of single bytes is what makes the method affordable in Python; the exact check
inside a range then works on bytes. Equal strings are told by 64-bit hashes.

Texts over ``SLICE`` bytes are read in slices that overlap by WIDTH - 1 bytes, so each string starts in exactly one slice; as
an anchor depends on its string only, a segment that a border cuts is compared string by string with the same results.

Cases: null texts are empty; texts shorter than WIDTH lose nothing; all copies of a repeated text go entirely (from WIDTH
bytes on); repeated rows count as copies; the runs removed from a text may leave invalid UTF-8, so digests are of bytes; an empty
table gives an empty result; doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import lookup, map_texts, mix64, pieces, saved, text_buffers, trim, tuned
from covertile.llm.gsaca import suffix_array

WIDTH, GRAM = 200, 64
SPAN = WIDTH - GRAM + 1  # places of an anchor in a string
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MOST_BITS = 28
#: String starts that are worked on at once; positions have 26 bits beside an anchor's hash.
SLICE = 1 << 22
#: Segments of one anchor that one task compares; beyond, strings are dealt by their hashes.
GROUP = 20_000
SPANS = "array<struct<start:bigint,end:bigint>>"

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def rolled(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)])
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1])


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor's place, anchor's hash) of the runs of strings that share an anchor."""
    z = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return z, z, z, z, z.astype(np.uint64)
    h = rolled(raw, GRAM)
    low = np.uint64((1 << 26) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = key
    for step in (1, 2, 4, 8, 16, 32, 64):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: len(m) - (SPAN - 128)], m[SPAN - 128 :])  # the least over SPAN places
    place = (m & low).astype(np.int64)
    size = np.diff(offsets)
    whole = size >= WIDTH
    lo = offsets[:-1][whole]
    hi = offsets[1:][whole] - WIDTH
    text = np.flatnonzero(whole)
    valid = np.zeros(len(place) + 1, np.int64)
    np.add.at(valid, lo, 1)
    np.add.at(valid, hi + 1, -1)
    ok = np.cumsum(valid)[:-1] > 0
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    new[lo] = True
    first = np.flatnonzero(new)
    if not len(first):
        return z, z, z, z, z.astype(np.uint64)
    own = np.searchsorted(lo, first, side="right") - 1
    last = np.minimum(np.append(first[1:] - 1, len(place)), hi[own])
    return text[own], first, last, place[first], h[place[first]]


def _shards(batch: pa.RecordBatch, met: set[bytes], most: int = SLICE) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch that the task has not met, long enough to hold a string, in slices of ``most`` string starts:
    (digests of the whole texts, bytes, offsets, each slice's place in its text)."""

    def shard(keys: list[bytes], texts: list[bytes], starts: list[int]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        return keys, np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])), np.array(starts, np.int64)

    for part in pieces(batch, 1 << 20):
        keys, texts, starts, held = [], [], [], 0
        for t in part.column("text").to_pylist():
            raw = (t or "").encode()
            if len(raw) < WIDTH:
                continue
            k = hashlib.sha256(raw).digest()[:16]
            if k in met:
                continue
            met.add(k)
            for at in range(0, len(raw) - WIDTH + 1, most):
                cut = raw[at : at + most + WIDTH - 1]
                if keys and held + len(cut) > most + WIDTH - 1:
                    yield shard(keys, texts, starts)
                    keys, texts, starts, held = [], [], [], 0
                keys.append(k)
                texts.append(cut)
                starts.append(at)
                held += len(cut)
        if keys:
            yield shard(keys, texts, starts)


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bits of the hashes ``b`` in a map of 2^bits places."""
    at = F.col("b").bitwiseAND(F.lit((1 << bits) - 1))
    maps = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("c")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    held = np.zeros(1 << (bits - 3), np.uint8)
    for c, raw in maps.toLocalIterator():
        held[c * 4096 : (c + 1) * 4096] = np.frombuffer(raw, np.uint8)
    return held.tobytes()


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _fields(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def anchors(docs: DataFrame, most: int = SLICE) -> DataFrame:
    """(b, n): how often each anchor begins a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for _, raw, offsets, _ in _shards(batch, met, most):
                h = segments(raw, offsets)[4]
                yield _fields({"b": pa.array(h.view(np.int64))})

    return docs.select("text").mapInArrow(run, "b long").groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def _segment_rows(docs: DataFrame, wanted, passed, most: int = SLICE) -> DataFrame:
    """(a, k, s0, o0, part): the segments of wanted anchors: text's digest, first start, its distance to the anchor, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        hot = np.frombuffer(passed.value, np.uint8)
        met: set[bytes] = set()
        for batch in batches:
            for keys, raw, offsets, starts in _shards(batch, met, most):
                text, first, last, place, h = segments(raw, offsets)
                keep = _in(bits, h) & ~_in(hot, h)
                text, first, last, place, h = (x[keep] for x in (text, first, last, place, h))
                data = raw.tobytes()
                part = [data[a : b + WIDTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield _fields({"a": pa.array(h.view(np.int64)), "k": pa.array([keys[t] for t in text.tolist()], pa.binary()), "s0": pa.array(first - offsets[text] + starts[text]), "o0": pa.array((place - first).astype(np.int32)), "part": pa.array(part, pa.binary())})

    return docs.select("text").mapInArrow(run, "a long, k binary, s0 long, o0 int, part binary")


def _string_rows(docs: DataFrame, passed, most: int = SLICE) -> DataFrame:
    """(f, k, s): every string of the anchors with very many segments, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(passed.value, np.uint8)
        met: set[bytes] = set()
        if not hot.any():
            return
        for batch in batches:
            for keys, raw, offsets, starts in _shards(batch, met, most):
                text, first, last, _, h = segments(raw, offsets)
                keep = _in(hot, h)
                text, first, last = text[keep], first[keep], last[keep]
                n = last - first + 1
                s = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                t = np.repeat(text, n)
                f = rolled(raw, WIDTH)[s]
                yield _fields({"f": pa.array(f.view(np.int64)), "k": pa.array([keys[x] for x in t.tolist()], pa.binary()), "s": pa.array(s - offsets[t] + starts[t])})

    return docs.select("text").mapInArrow(run, "f long, k binary, s long")


def repeated_in(a: np.ndarray, o0: np.ndarray, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last) of the runs of repeated strings in segments that come with all others of their anchors."""
    n = len(part)
    whole = [hashlib.blake2b(p + o.to_bytes(4, "little"), digest_size=8).digest() for p, o in zip(part, o0.tolist(), strict=True)]
    _, a = np.unique(a, return_inverse=True)
    # a token for each (anchor, segment), numbered by anchor, so that suffixes of one anchor stand together and equal segments side by side
    hashed = np.frombuffer(b"".join(whole), np.uint64)
    order = np.lexsort((hashed, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (hashed[order][1:] != hashed[order][:-1]))
    c = np.empty(n, np.int64)
    c[order] = np.cumsum(new)
    at = np.array(suffix_array(c.tolist()), np.int64)
    same_a = np.append(False, a[at][1:] == a[at][:-1])
    same_c = same_a & np.append(False, c[at][1:] == c[at][:-1])
    twin = same_c | np.append(same_c[1:], False)
    length = np.array([len(p) for p in part])
    runs = [(at[twin], np.zeros(twin.sum(), np.int64), length[at[twin]] - WIDTH)]
    # ranges of one anchor with different segments: one of each segment, string by string
    one = np.flatnonzero(~same_c)
    group = a[at[one]]
    several = np.zeros(len(one), bool)
    several[1:] |= group[1:] == group[:-1]
    several[:-1] |= group[1:] == group[:-1]
    seg = at[one[several]]
    if len(seg):
        raw = np.frombuffer(b"".join(part[i] for i in seg.tolist()), np.uint8)
        size = length[seg]
        begin = np.cumsum(size) - size
        m = size - WIDTH + 1
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        f = rolled(raw, WIDTH)[np.repeat(begin, m) + inner]
        owner = np.repeat(np.arange(len(seg)), m)
        key = mix64(f ^ mix64(a[seg][owner].astype(np.uint64) * np.uint64(BASE) + (o0[seg][owner] - inner).astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        eq = key[order][1:] == key[order][:-1]
        rep = np.zeros(len(key), bool)
        rep[order[1:]] |= eq
        rep[order[:-1]] |= eq
        start = np.flatnonzero(rep & ~(np.append(False, rep[:-1]) & np.append(False, owner[1:] == owner[:-1])))
        stop = np.flatnonzero(rep & ~(np.append(rep[1:], False) & np.append(owner[1:] == owner[:-1], False)))
        runs.append((seg[owner[start]], inner[start], inner[stop]))
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def _compare(rows: DataFrame) -> DataFrame:
    """(k, start, end): the bytes that repeated strings cover, from segments dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(upto: pa.Table) -> pa.RecordBatch | None:
            a = upto["a"].to_numpy()
            some = np.append(False, a[1:] == a[:-1]) | np.append(a[1:] == a[:-1], False)  # not alone with its anchor
            upto = upto.filter(pa.array(some[: len(a)]))
            if not upto.num_rows:
                return None
            part = upto["part"].to_pylist()
            seg, i, j = repeated_in(upto["a"].to_numpy(), upto["o0"].to_numpy(), part)
            s0 = upto["s0"].to_numpy()[seg]
            return _fields({"k": upto["k"].combine_chunks().take(pa.array(seg)), "start": pa.array(s0 + i), "end": pa.array(s0 + j + WIDTH)})

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 8192:
                continue
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if (out := flush(table.slice(0, cut))) is not None:
                yield out
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if held:
            if (out := flush(pa.Table.from_batches(held))) is not None:
                yield out

    parts = rows.repartition("a").sortWithinPartitions("a")
    return parts.mapInArrow(run, "k binary, start long, end long")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of intervals that overlap or touch."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > far[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], axis=1)


def joined_spans(spans: DataFrame) -> DataFrame:
    """(k, start, end): maximal runs of the spans of each text, so that what is gathered of a text is its runs, not its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, int, int] | None = None  # the last run may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("k").to_pylist()
            start, end = batch.column("start").to_numpy(), batch.column("end").to_numpy()
            if held is not None:
                keys, start, end = [held[0], *keys], np.append(held[1], start), np.append(held[2], end)
            k = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            text = np.cumsum(np.append(False, (k[1:] != k[:-1]).any(axis=1)))
            far = np.maximum.accumulate(end + (text << 40)) - (text << 40)  # the farthest end in the text so far
            new = np.append(True, (text[1:] != text[:-1]) | (start[1:] > far[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new)) - 1
            held = (keys[first[-1]], int(start[first[-1]]), int(far[-1]))
            if len(first) > 1:
                yield _fields({"k": pa.array([keys[i] for i in first[:-1].tolist()], pa.binary()), "start": pa.array(start[first[:-1]]), "end": pa.array(far[last[:-1]])})
        if held is not None:
            yield _fields({"k": pa.array([held[0]], pa.binary()), "start": pa.array([held[1]], pa.int64()), "end": pa.array([held[2]], pa.int64())})

    return spans.repartition("k").sortWithinPartitions("k", "start", "end").mapInArrow(run, "k binary, start long, end long")


def repeated_spans(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> DataFrame:
    """(k, spans): by the text's digest, the byte ranges that repeated strings cover, in order."""
    spark = tuned(docs.sparkSession)
    counted = saved(anchors(docs, most).filter("n > 1"))
    size = counted.count()
    bits = min(MOST_BITS, max(20, int(np.ceil(np.log2(max(1, size) * 16)))))
    wanted = spark.sparkContext.broadcast(_bitmap(counted.select("b"), bits))
    passed = spark.sparkContext.broadcast(_bitmap(counted.filter(F.col("n") > group).select("b"), 20))
    spans = _compare(_segment_rows(docs, wanted, passed, most))
    if not counted.filter(F.col("n") > group).isEmpty():
        strings = saved(_string_rows(docs, passed, most))  # read three times
        often = saved(strings.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("twice", F.lit(True)))
        # a string that a third of all texts hold is looked up without a shuffle by it
        far = lookup(strings, often, "f", "n").filter("twice")
        spans = spans.unionByName(far.select("k", F.col("s").alias("start"), (F.col("s") + WIDTH).alias("end")))
    return joined_spans(spans).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def removal(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(rows, edits): each row of ``docs`` without its text with k, d (digests), n_bytes, copies; and for texts that lose a part
    k and spans (merged, array of start and end)."""
    tuned(docs.sparkSession)

    def digests(texts: pa.Array) -> list[pa.Array]:
        raw, offsets = text_buffers(texts)
        data = raw.tobytes()
        full = [hashlib.sha256(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [pa.array(np.diff(offsets)), pa.array([x.digest()[:16] for x in full], pa.binary()), pa.array([x.hexdigest() for x in full], pa.string())]

    base = saved(map_texts(docs, digests, "n_bytes long, k binary, d string"))
    return base, saved(repeated_spans(docs, group, most))


def _apply(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(k, n_removed, n_spans, kept): the texts that lose a part, once each; a bitmap spares most others the shuffle."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_bitmap(edits.select(F.conv(F.hex(F.substring("k", 1, 3)), 16, 10).cast("long").alias("b")), 24))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        met: set[bytes] = set()
        for batch in batches:
            keys, texts = [], []
            for t in batch.column("text").to_pylist():
                raw = (t or "").encode()
                if len(raw) >= WIDTH:
                    k = hashlib.sha256(raw).digest()[:16]
                    b = int.from_bytes(k[:3], "big")
                    if bits[b >> 3] >> (b & 7) & 1 and k not in met:
                        met.add(k)
                        keys.append(k)
                        texts.append(raw)
            trim()
            yield _fields({"k": pa.array(keys, pa.binary()), "raw": pa.array(texts, pa.binary())})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("k", "raw", "spans")), strict=True):
                runs = _merged(np.array([(s["start"], s["end"]) for s in spans], np.int64))
                stay, at = [], 0
                for a, b in runs.tolist():
                    stay.append(raw[at:a])
                    at = b
                stay.append(raw[at:])
                out.append((k, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join(stay)))
            yield _fields({"k": pa.array([x[0] for x in out], pa.binary()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "n_spans": pa.array([x[2] for x in out], pa.int64()), "kept": pa.array([x[3] for x in out], pa.binary())})

    raws = docs.select("text").mapInArrow(keyed, "k binary, raw binary")
    return raws.join(edits, "k").mapInArrow(kept, "k binary, n_removed long, n_spans long, kept binary").dropDuplicates(["k"])


def report(docs: DataFrame, group: int = GROUP, most: int = SLICE) -> DataFrame:
    """The digest columns of the contract."""
    rows, edits = removal(docs.select("doc_id", "text"), group, most)
    done = saved(_apply(docs, edits).select("k", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    copied = rows.filter(F.col("n_bytes") >= WIDTH).groupBy("k").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # a text that stands twice goes entirely
    results = done.join(copied, "k", "left_anti").unionByName(copied.join(rows.select("k", "n_bytes").dropDuplicates(["k"]), "k").select("k", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")))
    return rows.join(results, "k", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "d").alias("kept_sha256"))
