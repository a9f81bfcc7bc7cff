"""Language identification with hyperdimensional profiles.

Letters have fixed random +1/-1 vectors. An n-gram is its letters' vectors, each rotated by its distance from the end,
multiplied together (binding); a text is the sum of its n-grams' vectors (bundling); so is a language's prototype. A text
has the language whose prototype makes the largest cosine with it.

Cases: a null text, or one without letters, gets ``und`` and score 0. Ties go to the smaller language name. Null
languages don't teach. Without any prototype every text is ``und``. Repeated rows get equal results. Texts are read whole, a long one in
stretches of 2^20 characters. An empty table gives an empty result. Other columns pass through; columns called lang_pred or score
give way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertile.llm.common import pieces, tuned

DIM, GRAM, SYMBOLS, SEED = 1024, 3, 1024, 20240611
UND = "und"


def _symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter (``str.isalpha``); letters up to U+024F have their own, the others share 431."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    points = np.flatnonzero(letter)
    table = np.zeros(0x110000, np.uint16)
    table[points] = np.where(points < 0x250, points + 1, 0x251 + points % (SYMBOLS - 0x251))
    return table


class Space:
    """The letters' vectors, rotated for each place in an n-gram."""

    def __init__(self) -> None:
        base = (np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (SYMBOLS, DIM)) * 2 - 1).astype(np.float32)
        self.placed = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.symbols = _symbols()

    def grams(self, text: str, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes and their counts; runs of other characters count as one space."""
        codes, counts = [], []
        carry = np.zeros(1, np.uint32)
        for i in range(0, len(text), chunk):
            s = self.symbols[np.frombuffer(text[i : i + chunk].lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.uint32)
            s = np.concatenate([carry, s])
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
            s = s[keep]
            carry = s[-(GRAM - 1) :]
            if i + chunk >= len(text) and s[-1]:
                s = np.append(s, np.uint32(0))
            if len(s) >= GRAM:
                u, n = np.unique((s[:-2] << np.uint32(20)) | (s[1:-1] << np.uint32(10)) | s[2:], return_counts=True)
                codes.append(u)
                counts.append(n)
        if not codes:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(codes) > 1:
            u, at = np.unique(np.concatenate(codes), return_inverse=True)
            return u, np.bincount(at, np.concatenate(counts)).astype(np.int64)
        return codes[0], counts[0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        v = self.placed[0][codes >> np.uint32(20)]
        v *= self.placed[1][(codes >> np.uint32(10)) & np.uint32(1023)]
        v *= self.placed[2][codes & np.uint32(1023)]
        return v

    def bundles(self, docs: list[tuple[np.ndarray, np.ndarray]], block: int = 4096) -> np.ndarray:
        """A row for each document: the sum of its n-grams' vectors. Sums are whole numbers below 2^24, so exact."""
        out = np.zeros((len(docs), DIM), np.float32)
        if not any(len(c) for c, _ in docs):
            return out
        codes = np.concatenate([c for c, _ in docs])
        rows = np.repeat(np.arange(len(docs)), [len(c) for c, _ in docs])
        u, at = np.unique(codes, return_inverse=True)
        counts = np.concatenate([n for _, n in docs]).astype(np.float32)
        order = np.argsort(at, kind="stable")
        at, rows, counts = at[order], rows[order], counts[order]
        for i in range(0, len(u), block):
            a, b = np.searchsorted(at, [i, i + block])
            part = np.zeros((len(docs), min(block, len(u) - i)), np.float32)
            part[rows[a:b], at[a:b] - i] = counts[a:b]
            out += part @ self.vectors(u[i : i + block])
        return out


_space: list[Space] = []


def space() -> Space:
    if not _space:
        _space.append(Space())
    return _space[0]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return u, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            codes, counts = space().grams(text.as_py() or "")
            if len(codes):
                parts = held.setdefault(lang.as_py(), [])
                parts.append((codes, counts))
                if len(parts) >= 512:
                    held[lang.as_py()] = [merged(parts)]
    for lang, parts in held.items():
        u, n = merged(parts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(u), pa.string()), "gram": u.astype(np.int64), "n": n})


def _bundle_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        gram, n = batch.column("gram").to_numpy().astype(np.uint32), batch.column("n").to_numpy().astype(np.float64)
        for lang in set(langs):
            own = np.nonzero(langs == lang)[0]
            total = sums.setdefault(lang, np.zeros(DIM))
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                total += n[part] @ space().vectors(gram[part]).astype(np.float64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIM, pa.string()), "at": np.arange(DIM, dtype=np.int64), "x": total})


def fit(docs: DataFrame) -> DataFrame:
    """Prototypes (lang, vector array<double>) of all rows of ``docs`` (text, lang): a row for each language."""
    tuned(docs.sparkSession)
    counts = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    dims = counts.mapInArrow(_bundle_grams, "lang string, at long, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    return dims.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector"))


def predict(docs: DataFrame, prototypes: DataFrame, max_languages: int = 4096) -> DataFrame:
    """``docs`` (text and other columns) with ``lang_pred`` and ``score``, the cosine held to 0..1.

    Prototypes are sent to every task: languages x 8 KB; more than ``max_languages`` is refused.
    """
    spark: SparkSession = tuned(docs.sparkSession)
    rows = sorted((r["lang"], r["vector"]) for r in prototypes.limit(max_languages + 1).collect())
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = [r[0] for r in rows]
    proto = np.array([r[1] for r in rows], np.float64).reshape(len(rows), DIM)
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-300)
    sent = spark.sparkContext.broadcast((names, proto))
    kept = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, proto = sent.value
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                grams = [space().grams(t.as_py() or "") for t in part.column("text")]
                v = space().bundles(grams).astype(np.float64)
                size = np.linalg.norm(v, axis=1)
                # without letters there is nothing but a space, which is too short for an n-gram
                known = np.array([len(c) > 0 for c, _ in grams], bool) & (size > 0) & bool(names)
                cos = (v @ proto.T) / np.maximum(size, 1e-300)[:, None] if names else np.zeros((len(grams), 1))
                best = cos.argmax(axis=1)
                lang = [names[b] if k else UND for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
                cols = [part.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "lang_pred", "score"])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), "text").mapInArrow(run, schema)
