"""Intervals along positions: union, runs, islands, compression, non-overlapping choice."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """(by, start, stop, n): maximal intervals; those that overlap or touch become one."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    far = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) > far, 1).otherwise(0)).over(w)
    return df.filter(F.col(stop) > F.col(start)).withColumn("_i", island).groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("n")).drop("_i")


def covered(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """(by, covered, first): union length and first start."""
    m = merge(df, by, start, stop)
    return m.groupBy(*by).agg(F.sum(F.col(stop) - F.col(start)).alias("covered"), F.min(start).alias("first"))


def runs(df: DataFrame, by: list[str], pos: str, active: Column) -> DataFrame:
    """(by, run_start, run_stop, run_width): stretches of consecutive positions that are active; positions are whole numbers."""
    w = Window.partitionBy(*by).orderBy(pos)
    on = df.filter(active).withColumn("_i", F.col(pos) - F.row_number().over(w))
    return on.groupBy(*by, "_i").agg(F.min(pos).alias("run_start"), F.max(pos).alias("run_stop"), F.count(F.lit(1)).alias("run_width")).drop("_i")


def extend(calls: DataFrame, run: DataFrame, by: list[str]) -> DataFrame:
    """Calls (start_iid, end_iid) extended by the runs that hold the window before and the window after; with run_found.

    The call's own windows needn't be active: only its two neighbours are looked up, each in the run that covers it.
    """
    cover = run.withColumn("iid", F.explode(F.sequence("run_start", "run_stop")))
    before = cover.select(*by, (F.col("iid") + 1).alias("start_iid"), F.col("run_start").alias("_s"))
    after = cover.select(*by, (F.col("iid") - 1).alias("end_iid"), F.col("run_stop").alias("_e"))
    inside = cover.select(*by, F.col("iid").alias("start_iid"), F.col("run_start").alias("_is"))
    j = calls.join(before, [*by, "start_iid"], "left").join(after, [*by, "end_iid"], "left").join(inside, [*by, "start_iid"], "left")
    j = j.withColumns({"ext_start": F.coalesce("_s", "start_iid"), "ext_stop": F.coalesce("_e", "end_iid"), "run_found": F.col("_s").isNotNull() | F.col("_e").isNotNull() | F.col("_is").isNotNull()})
    return j.drop("_s", "_e", "_is")


def gap_merge(segments: DataFrame, profile: DataFrame, by: list[str], merge_gap: int = 10, merge_floor: float = 0.25, merge_min: float = 0.5) -> DataFrame:
    """Neighbouring positive segments joined over short gaps; others stay and end the chain.

    ``segments``: by, start_iid, end_iid, n_windows, score_mean; ``profile``: by, iid, score. Two positive neighbours join if at
    most ``merge_gap`` windows lie between them and the gap's mean score (0 if there is none) exceeds ``merge_floor``. Gap
    means come from prefix sums, so only the segment before matters.
    """
    p = Window.partitionBy(*by).orderBy("iid").rowsBetween(Window.unboundedPreceding, 0)
    sums = profile.select(*by, "iid", F.sum(F.coalesce("score", F.lit(0.0))).over(p).alias("_s"), F.count("score").over(p).alias("_n"))
    w = Window.partitionBy(*by).orderBy("start_iid")
    s = segments.withColumn("positive", F.col("score_mean") > merge_min).withColumn("_pe", F.lag("end_iid").over(w)).withColumn("_pp", F.lag("positive").over(w))
    a = sums.select(*by, F.col("iid").alias("_pe"), F.col("_s").alias("_s0"), F.col("_n").alias("_n0"))
    b = sums.select(*by, (F.col("iid") + 1).alias("start_iid"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"))
    s = s.join(a, [*by, "_pe"], "left").join(b, [*by, "start_iid"], "left")
    gap = F.col("start_iid") - F.col("_pe") - 1
    mean = F.coalesce(F.try_divide(F.col("_s1") - F.col("_s0"), F.col("_n1") - F.col("_n0")), F.lit(0.0))
    joins = F.coalesce(F.col("positive") & F.col("_pp") & (gap <= merge_gap) & (mean > merge_floor), F.lit(False))
    s = s.withColumn("_i", F.sum((~joins).cast("int")).over(w))
    out = s.groupBy(*by, "_i").agg(
        F.min("start_iid").alias("start_iid"), F.max("end_iid").alias("end_iid"), F.sum("n_windows").alias("_w"), F.count(F.lit(1)).alias("n_merged"),
        (F.sum(F.col("score_mean") * F.col("n_windows")) / F.sum("n_windows")).alias("score_mean"),
    )
    return out.withColumn("n_windows", F.when(F.col("n_merged") > 1, F.col("end_iid") - F.col("start_iid") + 1).otherwise(F.col("_w"))).drop("_i", "_w")


def removed_before(points: DataFrame, cuts: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """``points`` with ``removed``: how much of the (merged) ``cuts`` (by, start, stop) lies before each, and ``kept_pos``.

    Cuts and points are sorted together once; a running sum over whole cuts and the last cut before a point give the rest.
    """
    c = merge(cuts, by, "start", "stop").select(*by, F.col("start").alias("_at"), F.lit(0).alias("_k"), "start", "stop")
    cols = [x for x in points.columns if x not in by]
    both = points.select(*by, F.col(pos).alias("_at"), F.lit(1).alias("_k"), F.struct(*cols).alias("_p")).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_sum": F.sum(F.coalesce(F.col("stop") - F.col("start"), F.lit(0))).over(w), "_last": F.last("stop", ignorenulls=True).over(w)})
    out = both.filter("_k = 1").withColumn("removed", F.col("_sum") - F.greatest(F.lit(0), F.coalesce(F.col("_last"), F.col("_at")) - F.col("_at")))
    return out.select(*by, "_p.*", "removed", (F.col("_at") - F.col("removed")).alias("kept_pos"))


def restored(points: DataFrame, cuts: DataFrame, by: list[str], pos: str = "kept_pos") -> DataFrame:
    """The inverse of ``removed_before``: ``original`` positions of compressed ones."""
    m = merge(cuts, by, "start", "stop")
    w = Window.partitionBy(*by).orderBy("start")
    c = m.withColumn("_before", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.select(*by, (F.col("start") - F.col("_before")).alias("_at"), F.lit(0).alias("_k"), (F.col("_before") + F.col("stop") - F.col("start")).alias("_shift"))
    cols = [x for x in points.columns if x not in by]
    both = points.select(*by, F.col(pos).alias("_at"), F.lit(1).alias("_k"), F.struct(*cols).alias("_p")).unionByName(c, allowMissingColumns=True)
    o = Window.partitionBy(*by).orderBy("_at", "_k", "_shift").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_s", F.coalesce(F.max("_shift").over(o), F.lit(0))).filter("_k = 1").select(*by, "_p.*", (F.col("_at") + F.col("_s")).alias("original"))


def resampled(profile: DataFrame, cuts: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, place, iid, score): the profile of ``n`` windows squeezed to what ``cuts`` (by, start, stop as fractions of 1) leave.

    max(2, round(n x what is left)) places; each takes the score of the window under its centre. Groups without cuts, or with
    nothing left, keep their windows.
    """
    m = merge(cuts, by, "start", "stop")
    left = m.groupBy(*by).agg((1 - F.sum(F.col("stop") - F.col("start"))).alias("_left"))
    size = profile.select(*by).distinct().join(left, by, "left").withColumn("_left", F.when(F.col("_left") > 0, F.col("_left")))
    size = size.withColumn("_n", F.when(F.col("_left").isNull(), F.lit(n)).otherwise(F.least(F.lit(n), F.greatest(F.lit(2), F.rint(F.col("_left") * n).cast("int")))))
    places = size.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("kept_pos", (F.col("place") + 0.5) / F.col("_n") * F.coalesce("_left", F.lit(1.0)))
    some = m.join(size.filter("_left is not null").select(*by), by, "left_semi")
    back = restored(places.select(*by, "place", "kept_pos"), some, by)
    back = back.withColumn("iid", F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col("original") * n))).cast("long"))
    return back.select(*by, "place", "iid").join(profile.select(*by, "iid", "score"), [*by, "iid"], "left").select(*by, "place", "iid", "score")


def choose(rows: list[tuple[int, int, float]]) -> list[int]:
    """Places of the non-overlapping closed intervals (start, end, weight > 0) of largest total weight; ties take the later one."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))
    ends = [rows[i][1] for i in order]
    best, take = [0.0], []
    for k, i in enumerate(order):
        j = bisect_left(ends, rows[i][0], 0, k)
        with_it = rows[i][2] + best[j]
        take.append((with_it >= best[k] and rows[i][2] > 0, j))
        best.append(max(with_it, best[k]) if rows[i][2] > 0 else best[k])
    out, k = [], len(order)
    while k:
        yes, j = take[k - 1]
        if yes:
            out.append(order[k - 1])
            k = j
        else:
            k -= 1
    return sorted(out)


def select_non_overlapping(df: DataFrame, by: list[str], start: str, end: str, weight: str) -> DataFrame:
    """The rows of each group that don't overlap and weigh most in all. A group is one contig's candidates.

    Sorted groups pass through a task one behind the other, in batches that don't end with them: many small groups cost what their rows do.
    """
    w = Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() for c in (end, start, weight)))

    def chosen(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held) if held else None
        if not t:
            return
        first = np.flatnonzero(t["_first"].to_numpy()).tolist()
        rows = list(zip(*(t[c].to_pandas().tolist() for c in (start, end, weight)), strict=True))
        keep = [a + i for a, z in zip(first, [*first[1:], len(rows)], strict=True) for i in choose(rows[a:z])]
        yield from t.drop_columns(["_first"]).take(keep).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            first = np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False))
            if len(first):
                at = int(first[-1])
                yield from chosen([*held, b.slice(0, at)])
                held = [b.slice(at)]
            else:
                held.append(b)
        yield from chosen(held)

    return df.withColumn("_first", F.row_number().over(w) == 1).mapInArrow(run, df.schema)


def heat_bins(profile: DataFrame, calls: DataFrame, by: list[str], n: int, bins: int = 120) -> DataFrame:
    """(by, bin, score): mean finite score of equal bins of window numbers; kept where a call covers the bin's centre."""
    b = max(40, min(bins, 120))
    p = profile.withColumn("bin", F.expr(f"iid * {b} div {n}")).groupBy(*by, "bin").agg(F.avg("score").alias("score"))
    centre = F.floor((F.col("bin") + 0.5) * n / b).cast("long")
    hit = calls.withColumn("iid", F.explode(F.sequence("start_iid", "end_iid"))).select(*by, "iid").distinct()
    return p.withColumn("iid", centre).join(hit, [*by, "iid"], "left_semi").drop("iid")
