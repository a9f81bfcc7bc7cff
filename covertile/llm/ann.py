"""Approximate nearest neighbours by collision counting over single projections.

Distinct vectors are dealt into shards. A shard sorts its vectors along each of ``PROJECTIONS`` random directions (the sorted arrays).
A query expands a window around its own projection in every array; the windows' radius is enlarged step by step (virtual
rehashing: nothing is hashed anew), and a vector that lies in at least ``threshold`` windows is verified by its exact distance.
A query is done in a shard once ``least`` vectors were verified there and the farthest of its best lies within what the windows'
radius makes likely, or when the windows hold everything. No cap is set on how many vectors are verified.

Equal vectors are one: a distinct vector carries its ``k`` + 1 smallest ids, which is all that a list of k needs, so a vector
that a third of all rows share is searched once.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part; vectors of different lengths never
meet; fewer candidates than k are all returned; ties go to the smaller id. Rows that repeat an id are one candidate, at the least of
their distances, and one query: a neighbour stands once in its list. An id is no neighbour of itself, whatever its vectors. Empty
tables give empty results. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.llm.common import saved, tuned

PROJECTIONS, SEED = 64, 7
#: A search ends when the k-th distance is within REACH x radius x sqrt(dimension): the windows then hold a vector at that
#: distance with probability erf(1 / (REACH x sqrt 2)) each, which has to exceed the threshold.
REACH = 1.4


class Shard:
    """The vectors of one shard (of one length) and their sorted arrays."""

    def __init__(self, ids: list[np.ndarray], vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        a = np.random.Generator(np.random.PCG64(SEED)).standard_normal((vectors.shape[1], PROJECTIONS))
        self.axes = a / np.linalg.norm(a, axis=0)
        p = vectors @ self.axes
        self.order = np.argsort(p, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, axis=0)

    def search(self, query: np.ndarray, k: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of at least the k nearest that were found, nearest first."""
        n = len(self.vectors)
        need = int(np.ceil(threshold * PROJECTIONS))
        center = query @ self.axes
        mid = np.array([np.searchsorted(self.sorted[:, j], center[j]) for j in range(PROJECTIONS)])
        # the first radius takes about 2 % of a typical array
        near = np.clip(np.stack([mid - n // 100 - 1, mid + n // 100]), 0, n - 1)
        radius = max(float(np.median(np.abs(self.sorted[near, np.arange(PROJECTIONS)] - center))), 1e-12)
        count = np.zeros(n, np.int16)
        lo, hi = mid.copy(), mid.copy()
        known = np.zeros(n, bool)
        places, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.sorted[:, j], center[j] - radius, "left")
                b = np.searchsorted(self.sorted[:, j], center[j] + radius, "right")
                a, b = min(a, lo[j]), max(b, hi[j])
                count[self.order[a : lo[j], j]] += 1
                count[self.order[hi[j] : b, j]] += 1
                lo[j], hi[j] = a, b
            new = np.flatnonzero((count >= need) & ~known)
            if len(new):
                known[new] = True
                d = self.vectors[new] - query
                places = np.concatenate([places, new])
                dist = np.concatenate([dist, np.sqrt((d * d).sum(axis=1))])
            if len(places) == n or (lo == 0).all() and (hi == n).all():
                break
            if len(places) >= max(k, least):
                # a vector at distance s differs along a random axis by about s / sqrt(dimension)
                kth = np.partition(dist, k - 1)[k - 1]
                if kth <= radius * np.sqrt(len(query)) * REACH:
                    break
            radius *= 1.25
        order = np.lexsort((places, dist))
        return places[order], dist[order]

    def nearest(self, query: np.ndarray, k: int, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k + 1 nearest rows, which may hold the query's own; ties to the smaller id."""
        places, dist = self.search(query, k + 1, threshold, least)
        if len(places) > k + 1:
            m = np.searchsorted(dist, dist[k], "right")
            places, dist = places[:m], dist[:m]
        ids = np.concatenate([self.ids[p] for p in places])
        d = np.repeat(dist, [len(self.ids[p]) for p in places])
        order = np.lexsort((ids, d))[: k + 1]
        return ids[order], d[order]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every usable vector once, with its k + 1 smallest ids. Ranks are cut before the shuffle."""
    e = F.col("embedding")
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    v = rows.filter(usable).select("vec_id", e.alias("v")).withColumn("h", F.xxhash64("v"))
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    few = v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    return few.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 65_536, threshold: float = 0.46, least: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest of ``rows`` (vec_id, embedding) but itself.

    Each shard's vectors stay in one task, at most about ``shard_rows`` x (16 x length + 12 x PROJECTIONS) bytes; the
    queries follow them in batches, so a task holds one shard and one batch, whatever the number of queries.
    """
    spark = tuned(rows.sparkSession)
    base = saved(distinct_vectors(rows, k))
    asked = saved(distinct_vectors(queries, k).select("h", "v"))
    shards = max(spark.sparkContext.defaultParallelism, -(-base.count() // shard_rows))
    dealt = base.select(F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "h", "v", "ids")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "h", "v", F.array().cast("array<bigint>").alias("ids"))
    # shards are numbered and even, so ranges give each a task of its own
    together = dealt.unionByName(sent).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"shard": None, "raw": {}, "made": {}}
        for batch in batches:
            shard, kind, h = (batch.column(c).to_numpy() for c in ("shard", "kind", "h"))
            vs, ids = batch.column("v"), batch.column("ids")
            out: dict[str, list] = {"h": [], "v": [], "vec_id": [], "score": []}
            for i in range(batch.num_rows):
                if shard[i] != state["shard"]:
                    state = {"shard": shard[i], "raw": {}, "made": {}}
                v = vs[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                if kind[i] == 0:
                    part = state["raw"].setdefault(len(v), ([], []))
                    part[0].append(ids[i].values.to_numpy())
                    part[1].append(v)
                    continue
                if len(v) in state["raw"]:
                    own = state["raw"].pop(len(v))
                    state["made"][len(v)] = Shard(own[0], np.array(own[1]))
                if len(v) in state["made"]:
                    found, d = state["made"][len(v)].nearest(v, k, threshold, least)
                    out["h"] += [h[i]] * len(found)
                    out["v"] += [vs[i]] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += d.tolist()
            if out["h"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array([x.as_py() for x in out["v"]], batch.schema.field("v").type), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))

    element = base.schema["v"].dataType.simpleString()
    found = together.mapInArrow(run, f"h long, v {element}, vec_id long, score double")
    best = Window.partitionBy("h", "v").orderBy("score", "vec_id")
    top = saved(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("h", "v", "vec_id", "score"))
    e = queries.filter("vec_id is not null").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v")).dropDuplicates()
    pairs = e.join(top, ["h", "v"]).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
