"""Evidence of donor components inside calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.operators.metrics import depth
from covertile.params import Params


def component_evidence(calls: DataFrame, metrics: DataFrame, scores: DataFrame, params: Params = Params(), support: float = 0.5) -> DataFrame:
    """(call_id, component, score_mean, score_median, score_max, supported_fraction, supported, n_windows, n_contigs, rank).

    A component's score in a window is the group's score plus ln(component depth) less ln(group's donor depth).
    """
    inside = calls.select(F.concat_ws("_", "sample", "grp", F.col("start_iid").cast("string"), F.col("end_iid").cast("string")).alias("call_id"), "sample", "grp", F.explode(F.sequence("start_iid", "end_iid")).alias("iid"))
    d = metrics.filter("role = 'donor'").select("sample", "grp", "iid", "chr_id", "component", F.coalesce(depth(params.metric, params.eps), F.lit(0.0)).alias("_d"))
    s = scores.select("sample", "grp", "iid", "score", "donor_mean")
    j = inside.join(s, ["sample", "grp", "iid"]).join(d, ["sample", "grp", "iid"])
    j = j.withColumn("_s", F.col("score") + F.log(F.col("_d") + params.eps) - F.log(F.col("donor_mean") + params.eps))
    a = j.groupBy("call_id", "component").agg(
        F.avg("_s").alias("score_mean"), F.median("_s").alias("score_median"), F.max("_s").alias("score_max"), F.avg((F.col("_s") > 0.5).cast("double")).alias("supported_fraction"),
        F.count("_s").alias("n_windows"), F.count_distinct("chr_id").alias("n_contigs"),
    )
    return a.withColumn("supported", F.col("supported_fraction") >= support).withColumn("rank", F.rank().over(Window.partitionBy("call_id").orderBy(F.desc("score_mean"))))


def dominant_component(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """Calls with donor_component, the one most frequent inside (ties: first by name)."""
    inside = calls.select("sample", "grp", "start_iid", "end_iid", F.explode(F.sequence("start_iid", "end_iid")).alias("iid"))
    n = inside.join(scores.filter("donor_component is not null").select("sample", "grp", "iid", "donor_component"), ["sample", "grp", "iid"]).groupBy("sample", "grp", "start_iid", "end_iid", "donor_component").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("sample", "grp", "start_iid", "end_iid").orderBy(F.desc("_n"), "donor_component")
    best = n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("sample", "grp", "start_iid", "end_iid", "donor_component")
    return calls.drop("donor_component").join(best, ["sample", "grp", "start_iid", "end_iid"], "left")
