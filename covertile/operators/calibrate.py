"""Length bins, null quantiles, thresholds and class cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.operators.robust import mixtures, normal_quantile, posterior
from covertile.params import Params
from covertile.plans.tables import saved


def bin_labels(bins_mb: tuple[float, ...]) -> list[str]:
    text = [f"{b:g}" for b in bins_mb]
    return [*(f"{a}-{b}" for a, b in zip(text[:-1], text[1:], strict=True)), f">{text[-1]}"]


def with_bin(calls: DataFrame, params: Params, width: str = "width_bp") -> DataFrame:
    """``calls`` with bin (0, 1, …) and length_bin; [a, b) bins, the last is open; NULL below the first break."""
    mb = F.col(width) / 1e6
    number = F.lit(None).cast("int")
    for k, a in enumerate(params.bins_mb):
        number = F.when(mb >= a, F.lit(k)).otherwise(number)
    labels = F.array(*(F.lit(x) for x in bin_labels(params.bins_mb)))
    return calls.withColumn("bin", number).withColumn("length_bin", F.get(labels, F.col("bin")))


def bin_table(spark, params: Params, mode: str) -> DataFrame:
    """(mode, bin, length_bin, floor): a few rows from the parameters."""
    rows = [(mode, k, label, float(f)) for k, (label, f) in enumerate(zip(bin_labels(params.bins_mb), params.floors(mode), strict=True))]
    return spark.createDataFrame(rows, "mode string, bin int, length_bin string, floor double")


def control_quantile(pool: DataFrame, fdr: float, least: int = 5) -> DataFrame:
    """(mode, bin, n_control, q99): values above their 95 % quantile go, then the (1 - fdr) quantile; NULL under 5 values."""
    cut = pool.groupBy("mode", "bin").agg(F.percentile("score_mean", 0.95).alias("_q"), F.count("score_mean").alias("n_control"))
    kept = pool.join(cut, ["mode", "bin"]).filter("score_mean <= _q")
    q = kept.groupBy("mode", "bin", "n_control").agg(F.percentile("score_mean", 1 - fdr).alias("q99"))
    return q.withColumn("q99", F.when(F.col("n_control") >= least, F.col("q99")))


def own_quantile(pool: DataFrame, fdr: float, mode: str, least: int = 5) -> DataFrame:
    """The same from the calls themselves, with the whole mode as bin -1: a mixture tells the lower component, whose quantile is the null.

    A null of too few values has the lower component's normal quantile in ``single`` mode, in ``multi`` it is NULL. Calls without a
    bin count in the mode only.
    """
    binned = pool.filter("bin is not null").select("mode", "bin", "score_mean")
    both = binned.unionByName(pool.select("mode", F.lit(-1).alias("bin"), "score_mean")).filter("score_mean is not null")
    mix = mixtures(both, ["mode", "bin"], "score_mean")
    j = both.join(mix, ["mode", "bin"]).withColumn("_null", posterior("score_mean") < 0.5)
    q = j.groupBy("mode", "bin", "mu0", "sd0").agg(F.count(F.lit(1)).alias("n_control"), F.count_if("_null").alias("n_null"), F.percentile(F.when(F.col("_null"), F.col("score_mean")), 1 - fdr).alias("_q"))
    z = normal_quantile(1 - fdr, 0.0, 1.0)
    normal = F.col("mu0") + F.lit(z) * F.col("sd0") if mode == "single" else F.lit(None).cast("double")
    q = q.withColumn("q99", F.when(F.col("n_control") >= least, F.when(F.col("n_null") >= least, F.col("_q")).otherwise(normal)))
    return q.select("mode", "bin", "n_control", "q99")


def calibration(calls: DataFrame, params: Params, mode: str, controls: DataFrame | None = None) -> DataFrame:
    """(mode, bin, length_bin, n_control, q99, threshold, fdr) for every bin: threshold = max(floor, q99 if known).

    ``controls`` (sample) are samples whose segments are the null; samples that are all controls are the same as none. Without
    controls, bins that know no q99 (too few values or none at all) borrow that of the whole mode.
    """
    pool = with_bin(calls, params).withColumn("mode", F.lit(mode))
    t = bin_table(calls.sparkSession, params, mode)
    if controls is not None:
        t = t.join(control_quantile(pool.filter("bin is not null").join(controls.select("sample").distinct(), "sample", "left_semi"), params.fdr), ["mode", "bin"], "left")
    else:
        q = saved(own_quantile(pool, params.fdr, mode))
        whole = q.filter("bin = -1").select("mode", F.col("q99").alias("_all"))
        t = t.join(q, ["mode", "bin"], "left").join(whole, "mode", "left").withColumn("q99", F.coalesce("q99", "_all"))
    return t.select("mode", "bin", "length_bin", F.coalesce("n_control", F.lit(0)).alias("n_control"), "q99", F.greatest("floor", "q99").alias("threshold"), F.lit(params.fdr).alias("fdr"))


def passing(calls: DataFrame, table: DataFrame, params: Params, mode: str) -> DataFrame:
    """Calls with their threshold and ``pass``: score_mean > threshold; no bin or no score fails."""
    c = with_bin(calls, params).withColumn("mode", F.lit(mode))
    j = c.join(F.broadcast(table.select("mode", "bin", "threshold")), ["mode", "bin"], "left")
    return j.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf")))).withColumn("pass", F.coalesce(F.col("score_mean") > F.col("threshold"), F.lit(False)))


#: The cutoffs of classes: the parameters' names.
CUTOFFS = ("donor_mod", "donor_high", "loss_mod", "loss_high", "total_mod", "total_high")


def _measured(where: Column, params: Params, least: int) -> Column:
    """The six cutoffs and the number of values from the rows ``where``, or NULL with fewer than ``least`` donor or recipient values.

    A high cutoff is never weaker than its moderate one, and none is weaker than its parameter; totals count without sign.
    """
    d, r, t = (F.when(where, c) for c in (F.col("donor_residual"), F.col("recipient_residual"), F.abs("total_residual")))
    donor_mod = F.greatest(F.lit(params.donor_mod), F.percentile(d, 0.95))
    loss_mod = F.least(F.lit(params.loss_mod), F.percentile(r, 0.05))
    known = F.count(t) >= least
    total_mod = F.when(known, F.greatest(F.lit(params.total_mod), F.percentile(t, 0.95))).otherwise(F.lit(params.total_mod))
    cut = F.struct(
        F.count(d).alias("n"), donor_mod.alias("donor_mod"), F.greatest(F.lit(params.donor_high), donor_mod, F.percentile(d, 0.99)).alias("donor_high"),
        loss_mod.alias("loss_mod"), F.least(F.lit(params.loss_high), loss_mod, F.percentile(r, 0.01)).alias("loss_high"),
        total_mod.alias("total_mod"), F.when(known, F.greatest(F.lit(params.total_high), total_mod, F.percentile(t, 0.99))).otherwise(F.lit(params.total_high)).alias("total_high"),
    )
    return F.when((F.count(d) >= least) & (F.count(r) >= least), cut)


def cutoffs(calls: DataFrame, params: Params, controls: DataFrame | None = None, least: int = 5, enough: int = 100, shrink: int = 20) -> DataFrame:
    """(mode, bin, n_control, the six cutoffs) of every (mode, bin) of ``calls``; bin -1 stands for calls without one.

    ``controls`` (sample): their calls are the null. A bin's values, where there are ``least``, are drawn to the whole mode's with
    weight n / (n + ``shrink``) if they are fewer than ``enough``; without them the mode's controls hold, then all its calls, then the
    parameters. Without controls among the samples the parameters hold. One grouping by (mode, bin) and by mode.
    """
    c = calls.withColumn("bin", F.coalesce("bin", F.lit(-1)))
    if controls is None:
        c = c.withColumn("_pool", F.lit(False))
    else:
        c = c.join(controls.select("sample", F.lit(True).alias("_in")).distinct(), "sample", "left").withColumn("_pool", F.col("_in").isNotNull())
    g = c.groupingSets([["mode", "bin"], ["mode"]], "mode", "bin").agg(F.grouping_id().alias("_g"), F.max("_pool").alias("_any"), _measured(F.col("_pool"), params, least).alias("_own"), _measured(F.lit(True), params, least).alias("_all"))
    whole = g.filter("_g <> 0").withColumn("_any", F.max("_any").over(Window.partitionBy(F.lit(0))))  # a row for each mode
    whole = whole.select("mode", F.when(F.col("_any"), F.coalesce("_own", "_all")).alias("_whole"))
    j = g.filter("_g = 0").join(whole, "mode")
    for k in CUTOFFS:
        j = j.withColumn(f"_w_{k}", F.coalesce(F.col("_whole")[k], F.lit(getattr(params, k))))
    w = F.when(F.col("_own.n") >= enough, 1.0).otherwise(F.col("_own.n") / (F.col("_own.n") + shrink))
    for k in CUTOFFS:
        j = j.withColumn(f"_b_{k}", w * F.col("_own")[k] + (1 - w) * F.col(f"_w_{k}"))
    # what shrinking has drawn together nests again
    up = {k: F.greatest(F.lit(getattr(params, k)), F.col(f"_b_{k}")) for k in ("donor_mod", "total_mod")}
    own = up | {
        "loss_mod": F.least(F.lit(params.loss_mod), F.col("_b_loss_mod")), "donor_high": F.greatest(F.lit(params.donor_high), up["donor_mod"], F.col("_b_donor_high")),
        "loss_high": F.least(F.lit(params.loss_high), F.col("_b_loss_mod"), F.col("_b_loss_high")), "total_high": F.greatest(F.lit(params.total_high), up["total_mod"], F.col("_b_total_high")),
    }
    return j.select("mode", "bin", F.coalesce(F.col("_own.n"), F.lit(0)).alias("n_control"), *(F.when(F.col("_own").isNotNull(), own[k]).otherwise(F.col(f"_w_{k}")).alias(k) for k in CUTOFFS))


def default_cutoffs(df: DataFrame, params: Params) -> DataFrame:
    """``df`` with the parameters' cutoffs where it has none."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(getattr(params, k))) if k in df.columns else F.lit(getattr(params, k)) for k in CUTOFFS})
