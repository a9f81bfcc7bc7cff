"""Benchmark decontamination with training suffix arrays.

Every task takes its documents in shards of a few MB and builds a word-level suffix array of each, of the suffixes whose
first three words begin some test suffix: a place where a test suffix occurs begins with its first words, so the others
could not be in any range that is searched, and leaving them out changes no result. Every test suffix is looked up by binary search; the
equal range holds the places where at least a window of it occurs verbatim. Neighbouring hits with the same shift join to the longest matches.

A window is 10 consecutive words of an item; an item of fewer, but not none, is one window. Test suffixes go to the tasks in
blocks of at most about ``block_words`` words (a block is some 20 MB); a larger benchmark takes more passes over the documents in the
same stage, never a larger broadcast.

Cases: null and empty texts have no words; items without words have no windows; items of equal text count each; repeated
rows get equal results; an empty benchmark hits nothing, an empty table of documents gives an empty result. An item whose id is null hits,
but is not counted or named, as it has no name. Texts are taken whole. ``report`` reads doc_id and text only; ``remove`` changes no
column; ``scan`` adds columns under names that must be free. Words are compared as 64-bit hashes, ten at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import keep_texts, pieces, text_buffers, tuned
from covertile.llm.words import ALNUM, FACTOR, mix64, words

WINDOW = 10
HEAD = 3
#: Stands for the id of an item without one.
NAMELESS = -(1 << 63)


def _rows(h: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` words at each place, 0 beyond the text's end."""
    pos = at[:, None] + np.arange(width)
    safe = np.minimum(pos, len(h) - 1)
    return np.where((pos < len(h)) & (doc[safe] == doc[at][:, None]), h[safe], np.uint64(0))


def _heads(rows: np.ndarray) -> np.ndarray:
    v = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        v = mix64((v ^ rows[:, k]) * FACTOR + np.uint64(k + 1))
    return v


class Windows:
    """The test suffixes of some items: distinct windows, in order, and the (item, word) where each stands."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        raw, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        _, _, doc, h = words(raw, offsets, ALNUM)
        _, first, count = np.unique(doc, return_index=True, return_counts=True)
        at = np.concatenate([np.arange(f, f + max(1, c - WINDOW + 1)) for f, c in zip(first, count, strict=True)]) if len(first) else np.zeros(0, np.int64)
        rows = _rows(h, doc, at, WINDOW) if len(at) else np.zeros((0, WINDOW), np.uint64)
        self.rows, where = np.unique(rows, axis=0, return_inverse=True)
        self.size = (self.rows != 0).sum(axis=1)
        order = np.argsort(where.ravel(), kind="stable")
        self.cuts = np.searchsorted(where.ravel()[order], np.arange(len(self.rows) + 1))
        self.item = np.array([NAMELESS if items[d][0] is None else items[d][0] for d in doc[at]], np.int64)[order] if len(at) else np.zeros(0, np.int64)
        starts = dict(zip(*np.unique(doc, return_index=True), strict=True))
        self.word = (at - np.array([starts[d] for d in doc[at]], np.int64))[order] if len(at) else np.zeros(0, np.int64)
        #: windows by the number of words that a lookup begins with
        self.heads = {}
        for k in range(1, HEAD + 1):
            own = np.flatnonzero(self.size >= HEAD if k == HEAD else self.size == k)
            if len(own):
                self.heads[k] = (own, _heads(self.rows[own, :k]))


def _bounds(sa_rows: np.ndarray, test: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every test suffix at once: the first row that is not below it (or above it) on ``size`` words."""
    lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(sa_rows), np.int64)
    counted = np.arange(test.shape[1])[None, :] < size[:, None]
    every = np.arange(len(test))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        row = sa_rows[np.minimum(mid, len(sa_rows) - 1)]
        differs = (row != test) & counted
        k = differs.argmax(axis=1)
        some = differs[every, k]
        below = np.where(some, row[every, k] < test[every, k], upper)
        go = lo < hi
        lo = np.where(go & below, mid + 1, lo)
        hi = np.where(go & ~below, mid, hi)
    return lo


def search(h: np.ndarray, doc: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word place, window) of every occurrence in one shard."""
    found_at, found_w = [], []
    for k, (own, heads) in w.heads.items():
        if len(h) < 1:
            continue
        v = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            v = mix64((v ^ h[i : len(h) - k + 1 + i]) * FACTOR + np.uint64(i + 1))
        # a small table of the heads' low bits lets most places go
        table = np.zeros(1 << 20, bool)
        table[(heads & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(table[(v & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[np.isin(v[at], heads)]
        if not len(at):
            continue
        rows = _rows(h, doc, at, WINDOW)
        order = np.lexsort(rows.T[::-1])  # the suffix array of what begins like a test suffix
        at, rows = at[order], rows[order]
        test = own[np.isin(heads, v[at])]
        lo = _bounds(rows, w.rows[test], w.size[test], False)
        hi = _bounds(rows, w.rows[test], w.size[test], True)
        n = hi - lo
        inside = _ragged(lo, n)
        found_at.append(at[inside])
        found_w.append(np.repeat(test, n))
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_w)


def _ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list for each of ``n`` texts, of values in order of texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _scan(texts: pa.Array, w: Windows) -> list[pa.Array]:
    raw, offsets = text_buffers(texts)
    _, _, doc, h = words(raw, offsets, ALNUM)
    n = len(texts)
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    at, win = search(h, doc, w)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + w.size[win], -1)
    hit = np.cumsum(cover)[:-1] > 0
    # a change of text inside a covered stretch ends one run and starts another
    mark = hit * (doc + 1)
    s = np.flatnonzero(hit & (mark != np.append(0, mark[:-1])))
    e = np.flatnonzero(hit & (mark != np.append(mark[1:], 0))) + 1
    own = doc[s] if len(s) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(s - first[own]), pa.array(e - first[own])], ["start", "end"])
    # every (text, item) once, with the longest run of words along one shift
    k = w.cuts[win + 1] - w.cuts[win]
    where = _ragged(w.cuts[win], k)
    o_at, o_item, o_word, o_size = np.repeat(at, k), w.item[where], w.word[where], np.repeat(w.size[win], k)
    o_doc = doc[o_at] if len(o_at) else np.zeros(0, np.int64)
    order = np.lexsort((o_at, o_at - o_word, o_item, o_doc))
    o_at, o_item, o_word, o_size, o_doc = (x[order] for x in (o_at, o_item, o_word, o_size, o_doc))
    new = np.ones(len(o_at), bool)
    if len(o_at) > 1:
        shift = o_at - o_word
        new[1:] = (o_doc[1:] != o_doc[:-1]) | (o_item[1:] != o_item[:-1]) | (shift[1:] != shift[:-1]) | (o_at[1:] != o_at[:-1] + 1)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(new))[: len(begin)] - 1  # of the run
    m_doc = o_doc[begin]
    matches = pa.StructArray.from_arrays([pa.array(o_item[begin]), pa.array(o_word[begin]), pa.array(o_at[begin] - first[m_doc]), pa.array(o_at[stop] + o_size[stop] - o_at[begin])], ["item_id", "item_word", "doc_word", "words"])
    return [pa.array(n_words, pa.int64()), _lists(own, n, spans), _lists(m_doc, n, matches)]


def _hits(texts: pa.Array, w: Windows) -> np.ndarray:
    """The number of windows that occur in each text."""
    raw, offsets = text_buffers(texts)
    _, _, doc, h = words(raw, offsets, ALNUM)
    at, _ = search(h, doc, w)
    return np.bincount(doc[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)


SPANS = "array<struct<start:bigint,end:bigint>>"
MATCHES = "array<struct<item_id:bigint,item_word:bigint,doc_word:bigint,words:bigint>>"


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded number of characters; the driver holds one block at a time."""
    block, held = [], 0
    for row in items.filter("text is not null").select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held > block_words * 6:
            yield block
            block, held = [], 0
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, block_words: int = 200_000) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (runs of hit words) and ``matches`` (longest matches with their places).

    Texts and other columns stay; no shuffle. Each block of the benchmark is one more pass inside the same stage.
    """
    spark = tuned(docs.sparkSession)
    out = docs
    blocks = 0
    for block in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Windows(block))
        out = _pass(out, sent, blocks)
        blocks += 1
    if not blocks:
        out = _pass(docs, spark.sparkContext.broadcast(Windows([])), 0)
        blocks = 1
    spans = F.flatten(F.array(*(F.col(f"_spans{b}") for b in range(blocks)))) if blocks > 1 else F.col("_spans0")
    matches = F.flatten(F.array(*(F.col(f"_matches{b}") for b in range(blocks)))) if blocks > 1 else F.col("_matches0")
    if blocks > 1:  # runs of several blocks may overlap
        spans = _union(spans)
    drop = [f"{m}{b}" for b in range(blocks) for m in ("_words", "_spans", "_matches")]
    return out.withColumns({"n_words": F.col("_words0"), "hits": spans, "matches": matches}).drop(*drop)


def _union(spans: Column) -> Column:
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )


def _pass(docs: DataFrame, sent, b: int) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *_scan(part.column("text"), w)], names=[*names, f"_words{b}", f"_spans{b}", f"_matches{b}"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"_words{b} long, _spans{b} {SPANS}, _matches{b} {MATCHES}"])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    s = scan(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    items = F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"] != F.lit(NAMELESS)), lambda m: m["item_id"]))
    return s.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, block_words: int = 200_000) -> DataFrame:
    """``docs`` without the documents that hold any window of the benchmark. Each block of it is one more pass in the same stage."""
    spark = tuned(docs.sparkSession)

    def clean(sent) -> Callable[[pa.Array], np.ndarray]:
        return lambda texts: _hits(texts, sent.value) == 0

    out = docs
    for block in _blocks(benchmark, block_words):
        out = keep_texts(out, clean(spark.sparkContext.broadcast(Windows(block))))
    return out
