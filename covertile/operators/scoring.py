"""Donor against recipient scores by sample, group and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.operators.metrics import depth
from covertile.params import Params


def composition(metrics: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """(component, copies) of recipient components; overrides win, unknown names are refused by the join's check."""
    base = metrics.filter("role = 'recipient'").groupBy("component").agg(F.first("copy_number", ignorenulls=True).alias("copies")).withColumn("copies", F.coalesce("copies", F.lit(2.0)))
    if not overrides:
        return base
    o = metrics.sparkSession.createDataFrame(sorted(overrides.items()), "component string, _o double")
    j = base.join(o, "component", "full")
    known = F.when(F.col("copies").isNull(), F.raise_error(F.concat(F.lit("unknown component: "), "component"))).otherwise(F.coalesce("_o", "copies"))
    return j.select("component", known.alias("copies"))


def recipient_side(metrics: DataFrame, params: Params, copies: DataFrame | None = None) -> DataFrame:
    """(sample, grp, iid, recipient_mean, …): unweighted mean over components that are present."""
    r = metrics.filter("role = 'recipient'").withColumn("_d", depth(params.metric, params.eps))
    if copies is not None:
        r = r.join(copies.filter("copies > 0").select("component"), "component", "left_semi")
    return r.groupBy("sample", "grp", "iid").agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("recipient_mean"), F.count_distinct("component").alias("n_recipient"), F.avg("gc").alias("gc_recipient"), F.avg("mapq_high_fraction").alias("mapq_recipient"))


def spread(metrics: DataFrame, role: str, params: Params) -> DataFrame:
    """(sample, grp, iid, spread): of each component's log depth less its median in the group, the largest less the smallest; 0 for one component."""
    d = metrics.filter(F.col("role") == role).withColumn("_l", F.log(depth(params.metric, params.eps) + params.eps))
    d = d.withColumn("_l", F.col("_l") - F.median("_l").over(Window.partitionBy("sample", "grp", "component")))
    return d.groupBy("sample", "grp", "iid").agg(F.when(F.count("_l") >= 2, F.max("_l") - F.min("_l")).otherwise(F.lit(0.0)).alias(f"{role}_spread"))


def score_pairs(metrics: DataFrame, params: Params = Params(), copies: DataFrame | None = None) -> DataFrame:
    """Scores of every (sample, grp, iid) that has both roles in its group.

    score = ln(donor + eps) - ln(recipient + eps), or ln(donor + eps) alone (score_type ``donor``). The donor's depth is
    the mean or sum of its components, or the component with the largest ratio (ties: the first by name).
    """
    eps = params.eps
    r = recipient_side(metrics, params, copies)
    d = metrics.filter("role = 'donor'").select("sample", "grp", "iid", "component", "gc", "mapq_high_fraction", F.coalesce(depth(params.metric, eps), F.lit(0.0)).alias("_d"))
    j = d.join(r, ["sample", "grp", "iid"]).withColumn("_delta", F.log(F.col("_d") + eps) - F.log(F.col("recipient_mean") + eps))
    best = F.min(F.struct((-F.col("_delta")).alias("k"), F.col("component").alias("c"), F.col("_d").alias("d")))
    keys = ["sample", "grp", "iid", "recipient_mean", "n_recipient", "gc_recipient", "mapq_recipient"]
    a = j.groupBy(*keys).agg(best.alias("b"), F.avg("_d").alias("_mean"), F.sum("_d").alias("_sum"), F.count_distinct("component").alias("n_donor"), F.count_if(F.col("_delta") > 0.5).alias("supported_donors"), F.avg("gc").alias("gc_donor"), F.avg("mapq_high_fraction").alias("mapq_donor"), F.min("component").alias("_one"))
    how = params.donor_aggregation
    donor = {"max": F.col("b.d"), "mean": F.col("_mean"), "sum": F.col("_sum")}[how]
    name = F.col("b.c") if how == "max" else F.when(F.col("n_donor") == 1, F.col("_one"))
    a = a.withColumn("donor_mean", donor).withColumn("donor_component", name)
    log_d, log_r = F.log(F.col("donor_mean") + eps), F.log(F.col("recipient_mean") + eps)
    mapq = F.coalesce((F.col("mapq_donor") + F.col("mapq_recipient")) / 2, "mapq_donor", "mapq_recipient")
    return a.select(
        "sample", "grp", "iid", (log_d - log_r if params.score_type == "ratio" else log_d).alias("score"), "donor_mean", "recipient_mean", "donor_component", "n_donor", "n_recipient", "supported_donors",
        "gc_donor", "gc_recipient", mapq.alias("mapq_high_fraction"), log_d.alias("log_donor"), log_r.alias("log_recipient"), F.log(F.col("donor_mean") + F.col("recipient_mean") + eps).alias("log_total"),
    ).withColumn("score_raw", F.col("score"))


def group_coordinates(scores: DataFrame, metrics: DataFrame, n: int) -> DataFrame:
    """Scores with start and stop scaled by the recipient's largest stop in the group."""
    size = metrics.filter("role = 'recipient'").groupBy("grp").agg(F.max("stop").alias("_l"))
    s = scores.join(size, "grp")
    return s.withColumns({"start": F.expr(f"iid * _l div {n}"), "stop": F.expr(f"(iid + 1) * _l div {n}")}).drop("_l")
