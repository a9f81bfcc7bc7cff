"""Windows that recur across a cohort, and what masking does to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.operators.robust import mixtures, posterior


def recurrence(scores: DataFrame, z: float = 0.5) -> DataFrame:
    """(grp, iid, f): the share of samples whose raw score exceeds ``z``."""
    return scores.groupBy("grp", "iid").agg(F.avg((F.col("score_raw") > z).cast("double")).alias("f"))


def recurrence_mask(scores: DataFrame, windows: DataFrame, z: float = 0.5) -> DataFrame:
    """(grp, iid, start, stop, f, posterior, mask, source) of each donor window once: one mixture of all windows' recurrences tells recurrent ones.

    Masked are windows of posterior over 0.5 and, in cohorts under 10 samples, of f over 0.5 too. A single sample masks
    none (source ``none``). A window of the grid without scores is an error. Values are counted before the mixture is fitted.
    """
    place = ["start", "stop"] if {"start", "stop"} <= set(windows.columns) else []
    grid = windows.filter("role = 'donor'").groupBy("grp", "iid").agg(F.count(F.lit(1)), *(F.min(c).alias(c) for c in place)).select("grp", "iid", *place)
    n = scores.agg(F.count_distinct("sample").alias("n")).first()[0]
    if n < 2:
        none = F.lit(None).cast("double")
        return grid.withColumns({"f": none, "posterior": none, "mask": F.lit(False), "source": F.lit("none")})
    f = recurrence(scores, z).withColumn("_one", F.lit(1))
    floor = 0.5 + 1e-9 if n < 10 else float("-inf")
    fit = f.join(F.broadcast(mixtures(f, ["_one"], "f")), "_one").drop("_one")
    j = grid.join(fit, ["grp", "iid"], "left")
    bad = F.raise_error(F.concat_ws(" ", F.lit("no scores of window"), "grp", F.col("iid").cast("string"))).cast("double")
    j = j.withColumn("f", F.when(F.col("mu0").isNull(), bad).otherwise(F.col("f"))).withColumn("posterior", posterior("f"))
    masked = F.coalesce((F.col("posterior") > 0.5) & (F.col("f") > floor), F.lit(False))
    return j.select("grp", "iid", *place, "f", "posterior", masked.alias("mask"), F.lit("cohort").alias("source"))


def mask_threshold(mask: DataFrame) -> DataFrame:
    """(threshold): the smallest recurrence among masked windows."""
    return mask.filter("mask").agg(F.min("f").alias("threshold"))


def fraction_mask(fractions: DataFrame, threshold: float) -> DataFrame:
    """A mask from given fractions and a fixed threshold."""
    return fractions.withColumn("mask", F.coalesce(F.col("f") > threshold, F.lit(False)))


def apply_mask(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Scores of masked windows become NULL; the rows stay."""
    m = mask.filter("mask").select("grp", "iid", F.lit(True).alias("_m"))
    return scores.join(m, ["grp", "iid"], "left").withColumn("score", F.when(F.col("_m").isNull(), F.col("score"))).withColumn("masked", F.col("_m").isNotNull()).drop("_m")
