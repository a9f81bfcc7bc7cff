"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words, pairs of neighbours and pairs with one word between, hashed to 2^18 places; a text has a feature or not.
Each coordinate has its own learning rate; the L1 term keeps weights at exactly zero until their gradients outgrow it, so
the model that is sent to tasks is a short list of (place, weight), 2^18 entries of 12 bytes at most.

Fitting takes a bounded sample of labelled rows: those with the ``max_rows`` smallest hashes of their id (24,576 unless
given). It is dealt into shards; each shard learns by itself, and the weights are averaged.

Cases: null and empty texts have no features and get the bias alone. Null labels don't teach. Without labelled rows every
score is 0. Repeated rows get equal scores, and teach as often as they stand there. Texts are read whole. An empty table gives an empty
result. ``score`` passes other columns through; columns called score or predicted give way to its own. ``reject`` changes no column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import keep_texts, map_texts, mix64, tuned

BITS = 18
SIZE = 1 << BITS
BIAS = SIZE  # one place more
CUT = 0.3


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place) of every word, pair and skip-pair, repeated ones too, and the number of words of each row."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))
    flat = pc.ascii_trim(words.flatten(), characters=".,;:!?\"'()[]{}|*#")
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    solid = pc.greater(pc.binary_length(flat), 0)  # blanks at the ends, or punctuation alone, are no words
    flat, row = flat.filter(solid), row[solid.to_numpy(zero_copy_only=False)]
    n = np.bincount(row, minlength=len(texts))
    enc = flat.dictionary_encode()
    known = np.fromiter(map(_hash, enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))
    hashed = mix64(known)[enc.indices.to_numpy()]
    places, rows = [hashed], [row]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(hashed) > gap:
            same = row[gap:] == row[:-gap]
            places.append(mix64(hashed[:-gap] * np.uint64(salt) + hashed[gap:])[same])
            rows.append(row[gap:][same])
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64), n


def distinct(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, place) once, in order of rows."""
    key = np.sort((rows << BITS) | places)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> BITS, key & (SIZE - 1)


def scale(words):
    """What a present feature counts: less in long texts, so that a few strong words show whatever the length."""
    return np.minimum(1.0, 20.0 / np.sqrt(np.maximum(words, 1)))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl_pass(docs: list[tuple[np.ndarray, float, int]], z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> None:
    """One FTRL-proximal pass over (places, value of each, label); z and n change in place."""
    for places, value, label in docs:
        at = np.append(places, BIAS)
        x = np.full(len(at), value)
        x[-1] = 1.0
        zi, ni = z[at], n[at]
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
        g = (_sigmoid(w @ x) - label) * x
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g


def fit(sample: DataFrame, shard_rows: int = 6_144, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2.0, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (places, values) learnt from ``sample`` (text, label 0/1), a bounded sample; place ``BIAS`` is the bias.

    The sample is dealt by hash into shards of about ``shard_rows``, each shard learns its own weights in ``passes`` passes,
    and the shards' weights are averaged. The driver gets the average only: 2^18 coordinates at most, whatever the input.
    """
    tuned(sample.sparkSession)
    rows = sample.filter("label is not null").select("text", F.col("label").cast("int").alias("label"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    shards = max(1, -(-rows.count() // shard_rows))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "label"], kind="stable")
        z, n, docs = np.zeros(SIZE + 1), np.zeros(SIZE + 1), []
        for i in range(0, len(pdf), 256):
            own, labels = pdf["text"].iloc[i : i + 256], pdf["label"].iloc[i : i + 256]
            row, place, words = occurrences(pa.array(own, pa.string()))
            row, place = distinct(row, place)
            cuts = np.searchsorted(row, np.arange(len(own) + 1))
            docs += [(place[cuts[k] : cuts[k + 1]].astype(np.int32), v, int(y)) for k, (v, y) in enumerate(zip(scale(words), labels, strict=True))]
        for _ in range(passes):
            ftrl_pass(docs, z, n, alpha, beta, l1, l2)
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
        at = np.nonzero(w)[0]
        return pd.DataFrame({"place": at, "w": w[at]})

    mean = rows.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInPandas(shard, "place int, w double").groupBy("place").agg((F.sum("w") / shards).alias("w"))
    got = mean.orderBy("place").toArrow()
    return got["place"].to_numpy(), got["w"].to_numpy()


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 24_576) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled rows, those with the smallest hashes of doc_id.

    The ids are chosen before the texts are read, so only a bounded list of ids is broadcast.
    """
    few = labels.filter("toxic is not null").select("doc_id", F.col("toxic").alias("label")).orderBy(F.xxhash64(F.col("doc_id")), "label").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label")


def probabilities(texts: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The score of each text; 0 without a model."""
    at, values = model
    if not len(at):
        return np.zeros(len(texts))
    w = np.zeros(SIZE + 1)
    w[at] = values
    row, place, words = occurrences(texts)
    some = w[place] != 0
    row, place = distinct(row[some], place[some])
    return _sigmoid(np.bincount(row, w[place], minlength=len(texts)) * scale(words) + w[BIAS])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0..1) and ``predicted`` (1 if score >= 0.3); its text stays only if ``keep_text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        s = probabilities(texts, sent.value)
        return [pa.array(s), pa.array((s >= CUT).astype(np.int32))]

    return map_texts(docs, run, "score double, predicted int", keep_text, piece=1 << 21)


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns stay as they are, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_texts(docs, lambda texts: probabilities(texts, sent.value) < CUT)
