"""Chromosome records: deleted and added contigs, their order, and nested calls with score arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import clamp
from covertile.operators.intervals import covered, merge, removed_before, resampled


def fractions(calls: DataFrame, lengths: DataFrame, n: int) -> DataFrame:
    """Calls with start_frac and end_frac in 0..1 on their group (grp, length); without bases, from window numbers."""
    j = calls.join(lengths, "grp", "left")
    start = F.coalesce(F.col("start_bp") / F.col("length"), F.col("start_iid") / F.lit(float(n)))
    end = F.coalesce(F.col("end_bp") / F.col("length"), (F.col("end_iid") + 1) / F.lit(float(n)))
    return j.withColumns({"start_frac": clamp(start, 0.0, 1.0), "end_frac": clamp(end, 0.0, 1.0)}).drop("length")


def covered_groups(calls: DataFrame, lengths: DataFrame, share: float = 0.95, start_max: float | None = 0.01) -> DataFrame:
    """(sample, grp, covered, share) of donor groups that passing gains cover: at least ``share``, beginning within ``start_max``."""
    c = covered(calls.filter("pass").filter(F.col("class").isin("addition", "substitution", "complex")), ["sample", "grp"], "start_bp", "end_bp").join(lengths, "grp")
    c = c.withColumn("share", F.col("covered") / F.col("length"))
    c = c.filter(F.col("share") >= share)
    return (c if start_max is None else c.filter(F.col("first") <= start_max * F.col("length"))).select("sample", "grp", "covered", "share")


def states(recipients: DataFrame, deleted: DataFrame, whole: DataFrame, partial: DataFrame) -> DataFrame:
    """(sample, grp, state): hidden recipients, whole and partial donors; what is whole is not partial (set operations)."""
    hidden = recipients.select("sample", "grp").intersect(deleted.select("sample", "grp"))
    only = partial.select("sample", "grp").subtract(whole.select("sample", "grp"))
    return hidden.withColumn("state", F.lit("deleted")).unionByName(whole.select("sample", "grp", F.lit("added").alias("state"))).unionByName(only.withColumn("state", F.lit("partial"))).distinct()


def ordered(items: DataFrame) -> DataFrame:
    """(sample, kind, grp, replaces) with ``position``: recipients in group order, added donors half a place after their own,
    unplaced ones a little later, a donor that substitutes a deleted recipient in its place."""
    anchor = items.filter("kind = 'recipient'").withColumn("_a", F.dense_rank().over(Window.partitionBy("sample").orderBy(F.expr("try_cast(grp as int)").asc_nulls_last(), "grp")).cast("double"))
    a = anchor.select("sample", F.col("grp").alias("_g"), "_a").distinct()
    j = items.withColumn("_g", F.coalesce("replaces", "grp")).join(a, ["sample", "_g"], "left")
    place = F.col("_a") + F.when(F.col("kind") == "recipient", 0.0).when(F.col("replaces").isNotNull(), 0.0).when(F.col("kind") == "added", 0.5).otherwise(0.6)
    return j.withColumn("position", F.row_number().over(Window.partitionBy("sample").orderBy(place.asc_nulls_last(), "grp", "kind"))).drop("_g", "_a")


def records(scores: DataFrame, calls: DataFrame, n: int, hidden: DataFrame | None = None) -> DataFrame:
    """(sample, grp, scores array<double>, calls array<struct>, n_windows) of each chromosome; arrays are in order of windows and starts.

    ``hidden`` (sample, grp, start, stop as fractions of 1): deletions that are not shown. Scores are squeezed to what is left of
    them; a call's shown fractions (from, to) move accordingly, and calls that lie in them go.
    """
    own = scores
    c = calls.withColumns({"from": F.col("start_iid") / F.lit(float(n)), "to": (F.col("end_iid") + 1) / F.lit(float(n))})
    if hidden is not None:
        own = resampled(scores, hidden, ["sample", "grp"], n).withColumnRenamed("iid", "_w").withColumnRenamed("place", "iid")
        left = merge(hidden, ["sample", "grp"], "start", "stop").groupBy("sample", "grp").agg((1 - F.sum(F.col("stop") - F.col("start"))).alias("_left"))
        for name in ("from", "to"):
            c = removed_before(c.withColumnRenamed(name, "pos"), hidden, ["sample", "grp"]).withColumn(name, F.col("kept_pos")).drop("pos", "removed", "kept_pos")
        c = c.join(left, ["sample", "grp"], "left")
        c = c.withColumns({name: F.col(name) / F.when(F.col("_left") > 0, F.col("_left")).otherwise(1.0) for name in ("from", "to")}).filter(F.col("to") > F.col("from")).drop("_left")
    s = own.groupBy("sample", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("iid", "score"))), lambda x: x["score"]).alias("scores"))
    c = c.groupBy("sample", "grp").agg(F.array_sort(F.collect_list(F.struct("start_iid", "end_iid", "class", "class_status", "pass", "score_mean", "from", "to"))).alias("calls"))
    return s.join(c, ["sample", "grp"], "left").withColumn("n_windows", F.lit(n))
