"""Summaries of metrics, scores, masks and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import ratio


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """By sample, group, role and component."""
    return metrics.groupBy("sample", "grp", "role", "component").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("chr_id").alias("n_contigs"), F.sum("count").alias("reads"), F.avg("breadth").alias("mean_breadth"),
        F.median("breadth").alias("median_breadth"), F.stddev_samp("breadth").alias("sd_breadth"), F.avg("lambda_count").alias("mean_lambda_count"),
    )


def contig_summary(metrics: DataFrame) -> DataFrame:
    """By sample and contig."""
    return metrics.groupBy("sample", "chr_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("count").alias("reads"), F.sum("covered").alias("covered"), F.avg("breadth").alias("mean_breadth"), F.max("breadth").alias("max_breadth"), F.avg("mapq_high_fraction").alias("mean_mapq_high"), F.avg("gc").alias("mean_gc"),
    )


def scores_summary(scores: DataFrame) -> DataFrame:
    """By sample and group."""
    return scores.groupBy("sample", "grp").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count("score").alias("n_finite"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.stddev_samp("score").alias("sd_score"), F.max("score").alias("max_score"), F.count_if(F.col("score") > 0.5).alias("n_positive"),
    )


def masks_summary(masks: DataFrame) -> DataFrame:
    """By group; ``source`` may say where a mask comes from."""
    m = masks if "source" in masks.columns else masks.withColumn("source", F.lit("cohort"))
    return m.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("mask").alias("n_masked"), F.avg(F.col("mask").cast("double")).alias("masked_fraction"), F.avg(F.when(F.col("mask"), F.col("f"))).alias("mean_f"), F.avg(F.when(F.col("mask"), F.col("posterior"))).alias("mean_posterior"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("mask"), F.col("source")))), ";").alias("sources"),
    )


def calls_by(calls: DataFrame, by: str) -> DataFrame:
    """Calls by class, class_status, copy_state or grp."""
    return calls.groupBy("sample", by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("pass").alias("n_pass"), F.count_if(F.col("class_confidence") == "high").alias("n_high"), F.sum("width_bp").alias("total_bp"), F.median("width_bp").alias("median_bp"), F.avg("score_mean").alias("mean_score"),
    )


CLASS_ORDER = ["substitution", "addition", "deletion", "complex", "other"]


def class_totals(calls: DataFrame) -> DataFrame:
    """(class, n, share, ord) over all samples, in the preferred order."""
    t = calls.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*(F.lit(c) for c in CLASS_ORDER)), F.col("class"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("ord", F.when(at > 0, at).otherwise(len(CLASS_ORDER) + 1).cast("int"))


def cohort_summary(metrics: DataFrame, calls: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """One row per sample: reads by role, rates, shares, counts by status and class, widths, mask burden."""
    reads = metrics.groupBy("sample").agg(
        F.sum("count").alias("reads"), F.sum(F.when(F.col("role") == "donor", F.col("count")).otherwise(0)).alias("donor_reads"), F.sum(F.when(F.col("role") == "recipient", F.col("count")).otherwise(0)).alias("recipient_reads"),
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("grp").alias("n_groups"), F.avg("breadth").alias("mean_breadth"), F.sum("length").alias("_bp"),
    )
    c = calls.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("pass").alias("n_pass"), *(F.count_if(F.col("class") == k).alias(f"n_{k}") for k in CLASS_ORDER), *(F.count_if(F.col("class_status") == k).alias(f"n_{k}") for k in ("confident", "ambiguous", "needs_review")),
        F.count_distinct("grp").alias("groups_with_calls"), F.sum("width_bp").alias("call_bp"), F.max("width_bp").alias("max_call_bp"), F.median("width_bp").alias("median_call_bp"),
    )
    j = reads.join(c, "sample", "left")
    counts = [x for x in c.columns if x not in ("sample", "max_call_bp", "median_call_bp")]
    j = j.withColumns({x: F.coalesce(x, F.lit(0)) for x in counts})
    j = j.withColumns({"reads_per_window": ratio("reads", "n_windows"), "donor_share": ratio("donor_reads", "reads"), "pass_rate": ratio("n_pass", "n_calls"), "calls_per_group": ratio("n_calls", "n_groups"), "call_share": ratio("call_bp", "_bp")}).drop("_bp")
    if masks is not None:
        burden = masks.agg(F.avg(F.col("mask").cast("double")).alias("masked_fraction")).first()[0]
        j = j.withColumn("masked_fraction", F.lit(burden))
    return j


def run_counters(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample, n_windows, masked_fraction, n_calls, n_high_confidence)."""
    s = scores.groupBy("sample").agg(F.count(F.lit(1)).alias("n_windows"), F.avg(F.col("score").isNull().cast("double")).alias("masked_fraction"))
    c = calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("class_confidence") == "high").alias("n_high_confidence"))
    return s.join(c, "sample", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_calls", "n_high_confidence")})


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, low, q1, median, q3, high): quartiles, and whiskers at the 0.5 and 99.5 % quantiles."""
    q = F.percentile(value, F.array(*(F.lit(p) for p in (0.005, 0.25, 0.5, 0.75, 0.995))))
    a = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q"))
    return a.select(*by, "n", *(F.col("_q")[i].alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))))


def display_limit(scores: DataFrame) -> DataFrame:
    """(score_limit): max(0.5, 99 % quantile of |score|)."""
    return scores.agg(F.greatest(F.lit(0.5), F.percentile(F.abs("score"), 0.99)).alias("score_limit"))


def residual_long(scores: DataFrame, columns: list[str]) -> DataFrame:
    """(sample, grp, iid, side, residual): the named columns below each other."""
    return scores.select("sample", "grp", "iid", *columns).unpivot(["sample", "grp", "iid"], columns, "side", "residual")
