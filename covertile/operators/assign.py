"""Assignment of calls to host contigs: residuals, null placements, thresholds, candidates, matching, labels.

Every step but the matching is a DataFrame query; the matching is one small grouped map per component of calls and contigs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import clamp
from covertile.operators.intervals import choose, runs
from covertile.operators.matching import best_matching, edge_components
from covertile.operators.robust import gc_regression, median_polish
from covertile.params import Params
from covertile.plans.tables import saved

LAGS = 10
BAD = -1e6
EPS = 1e-6


def recipient_residuals(metrics: DataFrame, params: Params = Params(), masks: DataFrame | None = None, cohort: bool = True) -> DataFrame:
    """Recipient windows (sample, chr_id, grp, iid, start, stop, …) with residual, depletion, masked, expected_breadth, contig_length.

    Log breadth depths are polished over (contig, window) x sample in a cohort, else regressed on GC per contig. Expected breadth is
    1 - exp(-median depth), over the unmasked samples of a window or the windows of a contig; it never follows from the residual,
    as a deletion of the whole contig would hide there.
    """
    own = [c for c in ("start", "stop", "breadth", "mapq_high_fraction") if c in metrics.columns]
    r = metrics.filter("role = 'recipient'").select("sample", "chr_id", "grp", "iid", "gc", "lambda_breadth", *own)
    r = r.withColumn("residual", F.log(F.greatest(F.coalesce("lambda_breadth", F.lit(0.0)), F.lit(0.0)) + EPS))
    if "breadth" not in own:
        r = r.withColumn("breadth", 1 - F.exp(-F.col("lambda_breadth")))
    if cohort:
        r = median_polish(r, ["chr_id", "iid"], "sample", "residual")
    else:
        r = gc_regression(r.withColumnRenamed("residual", "_y"), ["sample", "chr_id"], "_y", ["gc"]).drop("_y")
    if masks is not None:
        r = r.join(masks.filter("mask").select("grp", "iid", F.lit(True).alias("_m")), ["grp", "iid"], "left").withColumn("masked", F.col("_m").isNotNull()).drop("_m")
    else:
        r = r.withColumn("masked", F.lit(False))
    w = Window.partitionBy(*(["chr_id", "iid"] if cohort else ["sample", "chr_id"]))
    seen = F.when(~F.col("masked"), F.col("lambda_breadth")) if cohort else F.col("lambda_breadth")
    r = r.withColumns({"expected_breadth": clamp(1 - F.exp(-F.greatest(F.median(seen).over(w), F.lit(0.0))), 0.0, 1.0), "depletion": -F.col("residual")})
    # greatest passes NULL over: no depth in any sample is no expectation
    r = r.withColumn("expected_breadth", F.when(F.median(seen).over(w).isNotNull(), F.col("expected_breadth")))
    if "stop" in own:
        r = r.withColumn("contig_length", F.max("stop").over(Window.partitionBy("sample", "chr_id")))
    return r.drop("gc", "lambda_breadth")


def interval_stats(inside: DataFrame, keys: list[str], value: str = "depletion", order: str = "iid") -> DataFrame:
    """(keys, n, mean, se, lower, z, n_eff): lower = mean - 1.645 se; z = mean / se, NULL without a standard error.

    The effective number of values is n / max(1, 1 + 2 x the sum of autocorrelations to lag 10), between 1 and n; under four
    values, or equal ones, it is n. Lag products come from one window over the keys.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = inside.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, LAGS + 1)})
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *(F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, LAGS + 1)))
    rho = sum((F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) for k in range(1, LAGS + 1)), F.lit(0.0)) / F.col("_v")
    n = F.col("n").cast("double")
    some = (F.col("n") >= 4) & (F.col("_sd") > 0)
    a = a.withColumn("n_eff", F.when(some, F.least(n, F.greatest(F.lit(1.0), n / F.greatest(F.lit(1.0), 1 + 2 * rho)))).otherwise(n))
    a = a.withColumn("se", F.when(F.col("n") >= 2, F.col("_sd") / F.sqrt("n_eff")).otherwise(0.0)).withColumn("lower", F.col("mean") - 1.645 * F.col("se"))
    return a.withColumn("z", F.when(F.col("se") > 0, F.col("mean") / F.col("se"))).select(*keys, "n", "mean", "se", "lower", "z", "n_eff")


def prefix_moments(profile: DataFrame, keys: list[str], value: str, means: tuple[str, ...] = ()) -> DataFrame:
    """``profile`` (keys, iid, …) with _first and _last: what an interval from a window, or up to it, needs to know of all usable ones (``value`` known).

    ``_last`` are sums up to the last usable window at or before it: numbers, values, squares, the products with the 1 to 10 usable
    windows before, changes of value, known values of ``means``. ``_first`` are the sums at the first usable window at or after it, with
    those that the lag products of an interval starting there leave out. Values are taken less the profile's mean, so sums
    stay small. One shuffle by ``keys``, whatever the intervals are.
    """
    whole = Window.partitionBy(*keys)
    upto, on, lags = whole.orderBy("iid").rowsBetween(Window.unboundedPreceding, 0), whole.orderBy("iid").rowsBetween(0, Window.unboundedFollowing), range(1, LAGS + 1)
    usable, by = F.col(value).isNotNull(), ", ".join(f"`{k}`" for k in keys)
    at = lambda c, k: F.expr(f"{'lag' if k > 0 else 'lead'}({c}, {abs(k)}) ignore nulls over (partition by {by} order by iid)") if k else F.col(c)
    u = profile.withColumn("_mid", F.avg(value).over(whole)).withColumn("_x", F.col(value) - F.col("_mid"))
    own = {"_n": usable.cast("int"), "_s": F.col("_x"), "_q": F.col("_x") * F.col("_x"), "_c": (F.col("_x") != at("_x", 1)).cast("int")} | {f"_p{k}": F.col("_x") * at("_x", k) for k in lags}
    own |= {f"_m{k}": F.when(usable, F.col(c)) for k, c in enumerate(means)} | {f"_k{k}": (usable & F.col(c).isNotNull()).cast("int") for k, c in enumerate(means)}
    u = u.withColumns({f"_o{c}": F.coalesce(x, F.lit(0)) for c, x in own.items()})
    # sums are NULL where there is no value, so that lags of them count usable windows
    u = u.withColumns({c: F.when(usable, F.sum(f"_o{c}").over(upto)) for c in own})
    ends = F.struct("iid", "_mid", *own, F.array(*(at("_s", k) for k in lags)).alias("_before"))
    less = [(F.col(c) - F.col(f"_o{c}")).alias(c) for c in own if c[:2] not in ("_p", "_c")]
    starts = F.struct("iid", "_x", "_c", *less, F.array(*(at(f"_p{k}", 1 - k) for k in lags)).alias("_out"), F.array(*(at("_s", 1 - k) for k in lags)).alias("_after"))
    u = u.withColumns({"_e": F.when(usable, ends), "_b": F.when(usable, starts)})
    return u.select(*profile.columns, F.last("_e", True).over(upto).alias("_last"), F.first("_b", True).over(on).alias("_first"))


def interval_moments(intervals: DataFrame, means: tuple[str, ...] = ()) -> DataFrame:
    """``intervals`` (``_first`` of their first window, ``_last`` of their last) with n, mean, se, lower, z, n_eff as of ``interval_stats``, and ``means``.

    Sums of an interval are differences of the two; intervals without a usable window go. Equal values have no deviation at all.
    """
    a, b = F.col("_first"), F.col("_last")
    d = intervals.filter(a["iid"] <= b["iid"]).withColumn("n", (b["_n"] - a["_n"]).cast("long"))
    size, same = F.col("n").cast("double"), b["_c"] == a["_c"]
    d = d.withColumn("_m", F.when(same, a["_x"]).otherwise((b["_s"] - a["_s"]) / size))
    m = F.col("_m")
    d = d.withColumn("_v", F.when(same, 0.0).otherwise(F.greatest(F.lit(0.0), b["_q"] - a["_q"] - size * m * m)))
    # over pairs k apart, of (x - m)(y - m): their products less m times the sums of both ends, and m squared for each pair
    rho = F.lit(0.0)
    for k in range(1, LAGS + 1):
        late, early = b["_s"] - a["_after"][k - 1], b["_before"][k - 1] - a["_s"]
        product = b[f"_p{k}"] - a["_out"][k - 1]
        rho = rho + F.when(F.col("n") > k, product - m * (late + early) + (size - k) * m * m).otherwise(0.0)
    some = (F.col("n") >= 4) & (F.col("_v") > 0)
    d = d.withColumn("n_eff", F.when(some, F.least(size, F.greatest(F.lit(1.0), size / F.greatest(F.lit(1.0), 1 + 2 * rho / F.col("_v"))))).otherwise(size))
    d = d.withColumns({"mean": m + b["_mid"], "se": F.when(F.col("n") >= 2, F.sqrt(F.col("_v") / (size - 1)) / F.sqrt("n_eff")).otherwise(0.0)})
    d = d.withColumn("lower", F.col("mean") - 1.645 * F.col("se")).withColumn("z", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    d = d.withColumns({c: F.try_divide(b[f"_m{k}"] - a[f"_m{k}"], b[f"_k{k}"] - a[f"_k{k}"]) for k, c in enumerate(means)})
    return d.drop("_m", "_v")


def null_profile(residuals: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """(chr_id, grp, iid, dep, spread): of each recipient window the median and standard deviation of depletion over the null samples.

    ``controls`` (sample) are the null samples, else all are. dep is NULL where no null sample has an unmasked value. An
    event in one or two samples doesn't move a median.
    """
    r = residuals if controls is None else residuals.join(controls.select("sample").distinct(), "sample", "left_semi")
    seen = F.max((F.col("depletion").isNotNull() & ~F.col("masked")).cast("int")) > 0
    return r.groupBy("chr_id", "grp", "iid").agg(F.when(seen, F.median("depletion")).alias("dep"), F.coalesce(F.stddev_samp("depletion"), F.lit(0.0)).alias("spread"))


def null_placements(widths: DataFrame, profile: DataFrame, n: int, permutations: int = 64, bonus: float = 1.0) -> DataFrame:
    """(grp, width, permutation, chr_id, same, value): each (grp, width) placed on every contig by a fixed rule.

    Placement b on contig j (in order of names) starts at place ((b - 1) 37 + (j - 1) 101) mod m of the m windows with a value from which the
    width fits. value = mean - 1.645 spread / sqrt(windows), and ``bonus`` more on a contig of the group. Sums are
    differences of prefix sums; the null is the cohort's, so calls of one group and width share their placements.
    """
    p = Window.partitionBy("chr_id").orderBy("iid").rowsBetween(Window.unboundedPreceding, 0)
    valid = F.col("dep").isNotNull()
    sums = profile.withColumns({
        "_d": F.sum(F.coalesce("dep", F.lit(0.0))).over(p), "_s": F.sum(F.when(valid, F.col("spread")).otherwise(0.0)).over(p), "_n": F.sum(valid.cast("long")).over(p),
    })
    names = profile.select("chr_id", F.col("grp").alias("chr_grp")).distinct().withColumn("j", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("chr_id")))  # a row for each contig
    each = widths.select("grp", "width").distinct().filter(F.col("width").between(1, n)).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    t = each.join(F.broadcast(names))
    # the starts that fit on a contig are its windows with a value up to n - width
    room = sums.select("chr_id", (F.lit(n) - F.col("iid")).alias("width"), F.col("_n").alias("_m"))
    t = t.join(room, ["chr_id", "width"]).filter("_m > 0").withColumn("_r", ((F.col("permutation") - 1) * 37 + (F.col("j") - 1) * 101) % F.col("_m") + 1)
    first = sums.filter(valid).select("chr_id", F.col("_n").alias("_r"), F.col("iid").alias("_first"), (F.col("_d") - F.col("dep")).alias("_d0"), (F.col("_s") - F.col("spread")).alias("_s0"), (F.col("_n") - 1).alias("_n0"))
    t = t.join(first, ["chr_id", "_r"]).withColumn("_last", F.col("_first") + F.col("width") - 1)
    last = sums.select("chr_id", F.col("iid").alias("_last"), F.col("_d").alias("_d1"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"))
    t = t.join(last, ["chr_id", "_last"])
    k = F.col("_n1") - F.col("_n0")
    same = F.col("chr_grp") == F.col("grp")
    value = (F.col("_d1") - F.col("_d0")) / k - 1.645 * ((F.col("_s1") - F.col("_s0")) / k) / F.sqrt(k.cast("double")) + F.when(same, bonus).otherwise(0.0)
    return t.select("grp", "width", "permutation", "chr_id", same.alias("same"), value.alias("value"))


THRESHOLDS = ("min_depletion", "strong_depletion", "assignment_margin", "cross_margin", "run_threshold")


def null_of_widths(placements: DataFrame, least: int = 20) -> DataFrame:
    """(grp, width, n_null, four thresholds) of placements: quantiles over the permutations of the best contig, its lead over the
    second, and the lead of the best other group over the own. NULL under ``least`` permutations."""
    b = placements.groupBy("grp", "width", "permutation").agg(
        F.array_sort(F.collect_list(-F.col("value"))).alias("_v"), F.max(F.when(F.col("same"), F.col("value"))).alias("_same"), F.max(F.when(~F.col("same"), F.col("value"))).alias("_other")
    )  # as many values as there are contigs
    b = b.withColumns({"best": -F.get("_v", F.lit(0)), "second": -F.get("_v", F.lit(1))})
    a = b.groupBy("grp", "width").agg(
        F.count("best").alias("n_null"), F.percentile("best", 0.95).alias("min_depletion"), F.percentile("best", 0.99).alias("strong_depletion"),
        F.greatest(F.lit(0.0), F.percentile(F.col("best") - F.col("second"), 0.95)).alias("assignment_margin"), F.greatest(F.lit(0.0), F.percentile(F.col("_other") - F.col("_same"), 0.99)).alias("cross_margin"),
        F.count(F.col("best") - F.col("second")).alias("_m"), F.count(F.col("_other") - F.col("_same")).alias("_c"),
    )
    a = a.withColumns({"assignment_margin": F.when(F.col("_m") > 0, F.col("assignment_margin")), "cross_margin": F.when(F.col("_c") > 0, F.col("cross_margin"))}).drop("_m", "_c")
    return a.filter(F.col("n_null") >= least)


def null_thresholds(calls: DataFrame, profile: DataFrame, n: int, permutations: int = 64, min_calls: int = 5, min_null: int = 20, bonus: float = 1.0, shrink: int = 20) -> DataFrame:
    """(mode, bin, n_null, min_depletion, strong_depletion, assignment_margin, cross_margin, run_threshold) that random placement reaches.

    A bin's value is the median over its calls, drawn to the mode's median with weight k / (k + ``shrink``) for k calls; bin -1 are
    calls without one. Under ``min_calls`` calls there are no rows. run_threshold is the 95 % quantile of the profile, 0.5 at least.
    """
    c = calls.select(F.col("mode"), F.coalesce("bin", F.lit(-1)).alias("bin"), "grp", (F.col("end_iid") - F.col("start_iid") + 1).alias("width"))
    run = profile.agg(F.when(F.count("dep") >= min_null, F.greatest(F.lit(0.5), F.percentile("dep", 0.95))).alias("run_threshold"))
    each = c.join(null_of_widths(null_placements(c, profile, n, max(8, permutations), bonus), min_null), ["grp", "width"]).join(F.broadcast(run)).join(F.broadcast(c.agg(F.count(F.lit(1)).alias("_calls")))).filter(F.col("_calls") >= min_calls)
    g = each.groupingSets([["mode", "bin"], ["mode"]], "mode", "bin").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_k"), F.sum("n_null").alias("n_null"), *(F.median(t).alias(t) for t in THRESHOLDS))
    whole = g.filter("_g <> 0").select("mode", *(F.col(t).alias(f"_{t}") for t in THRESHOLDS))
    j = g.filter("_g = 0").join(whole, "mode")
    w = F.col("_k") / (F.col("_k") + shrink)
    return j.select("mode", "bin", "n_null", *(F.coalesce(w * F.col(t) + (1 - w) * F.col(f"_{t}"), t, f"_{t}").alias(t) for t in THRESHOLDS))


def with_thresholds(calls: DataFrame, params: Params = Params(), null: DataFrame | None = None, cutoffs: DataFrame | None = None) -> DataFrame:
    """``calls`` (mode, bin) with the thresholds of assignment: the null's and the class cutoffs' where they are known, else the parameters'.

    A local loss needs a depletion of ``loss_depletion``: minus the loss cutoff, 0.5 at least. Without cutoffs totals don't decide.
    """
    c = calls.withColumn("_bin", F.coalesce("bin", F.lit(-1)))
    if null is not None:
        c = c.join(F.broadcast(null.select("mode", F.col("bin").alias("_bin"), *(F.col(t).alias(f"_{t}") for t in THRESHOLDS))), ["mode", "_bin"], "left")
    own = {t: F.coalesce(f"_{t}", F.lit(getattr(params, t))) if null is not None else F.lit(getattr(params, t)) for t in THRESHOLDS}
    c = c.withColumns({f"a_{t}": x for t, x in own.items()}).drop(*(f"_{t}" for t in THRESHOLDS))
    if cutoffs is not None:
        c = c.join(F.broadcast(cutoffs.select("mode", F.col("bin").alias("_bin"), F.col("donor_mod").alias("_dm"), F.col("loss_mod").alias("_lm"), F.col("total_mod").alias("_tm"))), ["mode", "_bin"], "left")
        more = {"a_donor_mod": F.coalesce("_dm", F.lit(params.donor_mod)), "a_loss_depletion": F.coalesce(F.greatest(F.lit(0.5), -F.col("_lm")), F.lit(params.loss_depletion)), "a_total_mod": F.col("_tm")}
    else:
        more = {"a_donor_mod": F.lit(params.donor_mod), "a_loss_depletion": F.lit(params.loss_depletion), "a_total_mod": F.lit(None).cast("double")}
    return c.withColumns(more).drop("_bin", "_dm", "_lm", "_tm")


def candidates(calls: DataFrame, residuals: DataFrame, n: int, params: Params = Params()) -> DataFrame:
    """A row for each call (of ``with_thresholds``) and recipient contig of its sample: depletion statistics, run, width and score.

    A call's statistics on a contig come from two of the contig's windows, its first and its last, by ``prefix_moments``: no window in
    between is looked at, so there are as many rows as calls and contigs. ``residuals`` has a row for each of the ``n`` windows of a
    contig; fewer are an error. Runs are windows whose depletion exceeds the call's run threshold;
    these take few values (one a bin). A contig without a usable window inside the call is no candidate.
    """
    p = params
    length = F.coalesce("donor_length", F.col("end_bp")) if "donor_length" in calls.columns else F.col("end_bp")
    c = calls.select("call_id", "sample", F.col("grp").alias("call_grp"), "start_iid", "end_iid", "start_bp", "end_bp", "width_bp", length.alias("donor_length"), *(f"a_{t}" for t in THRESHOLDS))
    place = ["sample", "chr_id"]
    each = Window.partitionBy(*place).orderBy("iid")
    fewer = F.raise_error(F.concat_ws(" ", F.lit("windows are missing:"), *place)).cast(dict(residuals.dtypes)["iid"])
    residuals = residuals.withColumn("iid", F.when(F.count(F.lit(1)).over(Window.partitionBy(*place)) >= n, F.col("iid")).otherwise(fewer))
    known = F.when(~F.col("masked"), F.col("iid"))
    named = {"expected_breadth": "expected_breadth", "observed_breadth": "breadth"} | ({"mapq_fraction": "mapq_high_fraction"} if "mapq_high_fraction" in residuals.columns else {})
    profile = residuals.select(*place, "grp", "iid", F.when(~F.col("masked"), F.col("depletion")).alias("depletion"), *(F.col(c).alias(n) for n, c in named.items()), F.last(known, True).over(each).alias("_hi"), F.first(known, True).over(each.rowsBetween(0, Window.unboundedFollowing)).alias("_lo"))
    sums = saved(prefix_moments(profile, place, "depletion", tuple(named)))
    first = sums.select(*place, "grp", F.col("iid").alias("start_iid"), "_first", "_lo")
    last = sums.select(*place, F.col("iid").alias("end_iid"), "_last", "_hi")
    contigs = sums.select(*place).distinct()
    e = c.join(contigs, "sample").join(first, [*place, "start_iid"]).join(last, [*place, "end_iid"])
    e = interval_moments(e, tuple(named))
    if "mapq_fraction" not in named:
        e = e.withColumn("mapq_fraction", F.lit(None).cast("double"))
    # each sample's windows once for each run threshold that its calls have, one a (mode, bin)
    by = [*place, "a_run_threshold"]
    leveled = saved(profile.filter("depletion is not null").select(*place, "iid", "depletion").join(calls.select("sample", "a_run_threshold").distinct(), "sample"))
    active = F.col("depletion") > F.col("a_run_threshold")
    # the last active window up to the call's last usable one lies inside, if any does
    latest = leveled.select(*by, F.col("iid").alias("_u"), F.last(F.when(active, F.col("iid")), True).over(Window.partitionBy(*by).orderBy("iid")).alias("_active"))
    e = e.withColumn("_u", F.col("_last.iid")).join(latest, [*by, "_u"], "left").withColumn("run_found", F.coalesce(F.col("_active") >= F.col("start_iid"), F.lit(False)))
    cover = runs(leveled, by, "iid", active).withColumn("iid", F.explode(F.sequence("run_start", "run_stop")))
    e = e.drop("_first", "_last", "_u", "_active")
    e = e.join(cover.select(*by, (F.col("iid") + 1).alias("_lo"), F.col("run_start").alias("_s")), [*by, "_lo"], "left").join(cover.select(*by, (F.col("iid") - 1).alias("_hi"), F.col("run_stop").alias("_e")), [*by, "_hi"], "left")
    e = e.withColumns({"run_start_iid": F.when(F.col("run_found"), F.coalesce("_s", "_lo")).otherwise(F.col("_lo")), "run_end_iid": F.when(F.col("run_found"), F.coalesce("_e", "_hi")).otherwise(F.col("_hi"))})
    typical = residuals.filter("not masked").groupBy("sample").agg(F.median("breadth").alias("_typical"))
    size = residuals.groupBy("chr_id").agg(F.max("contig_length" if "contig_length" in residuals.columns else F.lit(n)).alias("_size"))
    e = e.join(typical, "sample", "left").join(size, "chr_id")
    at = lambda iid: F.floor(iid * F.col("_size") / F.lit(float(n)))
    e = e.withColumns({"run_width_bp": at(F.col("run_end_iid") + 1) - at(F.col("run_start_iid")), "run_start_bp": at(F.col("run_start_iid")), "run_end_bp": at(F.col("run_end_iid") + 1), "inside_start_bp": at(F.col("start_iid")), "inside_end_bp": at(F.col("end_iid") + 1)})
    e = e.withColumns({"donor_fraction": F.coalesce(F.try_divide(F.col("width_bp"), F.col("donor_length")), F.lit(1.0)), "run_fraction": F.coalesce(F.try_divide(F.col("run_width_bp"), F.col("_size")), F.lit(1.0))})
    whole_call, whole_run = F.col("donor_fraction") >= 0.95, F.col("run_fraction") >= 0.95
    ratio = F.try_divide(F.col("donor_fraction"), F.when(F.col("run_fraction") > 0, F.col("run_fraction")))
    penalty = F.when(whole_call & whole_run, 0.0).when(whole_call | whole_run, -p.whole_penalty).when(ratio > 0, -p.width_lambda * F.abs(F.log(ratio))).otherwise(-p.whole_penalty)
    tol = 1.0 / n
    d0, d1 = F.greatest(F.lit(0.0), F.col("start_bp") / F.col("donor_length") - tol), F.least(F.lit(1.0), F.col("end_bp") / F.col("donor_length") + tol)
    r0, r1 = F.greatest(F.lit(0.0), F.col("run_start_bp") / F.col("_size") - tol), F.least(F.lit(1.0), F.col("run_end_bp") / F.col("_size") + tol)
    overlap = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least(d1, r1) - F.greatest(d0, r0)), F.greatest(d1 - d0, r1 - r0)), F.lit(0.0))
    floor = F.greatest(F.lit(p.min_expected_breadth), p.relative_floor * F.col("_typical"))
    reliable = F.coalesce((F.col("expected_breadth") >= floor) & (F.col("lower") >= F.col("a_min_depletion")) & ~(whole_call & ~whole_run), F.lit(False))
    e = e.withColumns({"same_group": F.col("grp") == F.col("call_grp"), "width_ratio": ratio, "overlap": overlap, "width_penalty": penalty, "reliable": reliable})
    e = e.withColumn("strong", F.col("reliable") & F.col("run_found") & (F.col("expected_breadth") >= 2 * p.min_expected_breadth) & (F.col("lower") >= F.col("a_strong_depletion")))
    score = F.when(F.col("reliable"), F.col("lower") + F.when(F.col("same_group"), p.same_group_bonus).otherwise(0.0) + F.col("width_penalty")).otherwise(F.lit(BAD))
    return e.withColumn("score", score).drop("_lo", "_hi", "_s", "_e", "_typical", "_size")


def match_hosts(cands: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, chr_id, second) of the calls that get a host: one to one within a sample, then leftovers where runs are free.

    The sum of scores is largest, one point of a passing call outweighs all others; having no host scores 0, so only candidates with
    a positive score count. Leftover calls may join a contig whose assigned runs they don't overlap: contigs in order of their best
    candidate, the best non-overlapping set on each. A component's leftovers are one group; a sample has no more calls than windows.
    """
    passes = F.coalesce("pass", F.lit(False))
    rows = cands.join(calls.select("call_id", passes.alias("passes")), "call_id").filter("score > 0")
    rows = saved(rows.select("sample", F.col("call_id").alias("left"), F.col("chr_id").alias("right"), "score", "reliable", "run_start_iid", "run_end_iid", "passes", (F.col("score") * F.when(F.col("passes"), 1e6).otherwise(1.0)).alias("gain")))
    hosts = saved(best_matching(rows, ["sample"]))
    parts = saved(edge_components(rows, ["sample"]))
    first = rows.join(hosts.select("sample", "left", F.col("right").alias("host")), ["sample", "left"], "left").join(parts, ["sample", "right"])
    # runs of hosted calls on their own host, and candidates of calls without one
    open_rows = first.filter("host = right or (host is null and reliable)")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = pdf[pdf["host"].notna()]
        left = pdf[pdf["host"].isna()].sort_values(["left", "right"])
        left = left.assign(order=left["score"] + np.where(left["passes"], 1e6, 0.0))
        out: list[tuple] = []
        placed: set = set()
        for chr_id in left.groupby("right")["order"].max().sort_values(ascending=False, kind="stable").index:
            own = left[(left["right"] == chr_id) & ~left["left"].isin(placed)]
            start, stop = own["run_start_iid"].to_numpy(), own["run_end_iid"].to_numpy()
            ok = np.ones(len(own), bool)
            for a, b in taken.loc[taken["right"] == chr_id, ["run_start_iid", "run_end_iid"]].itertuples(index=False):
                ok &= (stop < a) | (start > b)
            own = own[ok]
            for k in choose(list(zip(own["run_start_iid"], own["run_end_iid"], own["order"], strict=True))):
                placed.add(own["left"].iloc[k])
                out.append((own["left"].iloc[k], chr_id, True))
        return pd.DataFrame(out, columns=["call_id", "chr_id", "second"])

    second = open_rows.groupBy("sample", "component").applyInPandas(place, "call_id string, chr_id string, second boolean")
    return hosts.select(F.col("left").alias("call_id"), F.col("right").alias("chr_id"), F.lit(False).alias("second")).unionByName(second)


def labelled(cands: DataFrame, hosts: DataFrame) -> DataFrame:
    """(call_id, chosen candidate's columns, margin, weight, runner_up, runner_up_score, recipient_assignment) of every call with a candidate.

    Only reliable candidates count as alternatives. A call without a host has no_recipient_loss, weight 0 and NULL columns of the host.
    """
    j = cands.join(hosts.select("call_id", F.col("chr_id").alias("_h")), "call_id", "left").withColumn("_chosen", F.coalesce(F.col("chr_id") == F.col("_h"), F.lit(False)))
    real = F.col("score") > -1e5
    host = F.struct(*(c for c in cands.columns if c != "call_id"))
    # the first contig by name of those with the best score
    a = j.groupBy("call_id").agg(
        F.max(F.when(F.col("_chosen"), host)).alias("_b"), F.min(F.when(real & ~F.col("_chosen"), F.struct((-F.col("score")).alias("s"), F.col("chr_id").alias("c")))).alias("_next"),
        F.max(F.when(real & F.col("same_group"), F.col("score"))).alias("_same"), F.collect_list(F.when(real, F.col("score"))).alias("_scores"),
    )
    b = F.col("_b")
    top = F.array_max("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda t, x: t + F.exp(x - top))
    weight = F.when(b.isNull(), 0.0).when(b["score"] > -1e5, F.exp(b["score"] - top) / total).otherwise(0.0)
    margin = b["score"] - F.greatest(F.lit(0.0), -F.col("_next.s"))
    label = (
        F.when(b.isNull(), "no_recipient_loss").when(~b["reliable"] | ~b["strong"], "ambiguous").when(~b["same_group"] & F.col("_same").isNull(), "cross_group")
        .when(~b["same_group"] & (b["score"] - F.col("_same") < b["a_cross_margin"]), "ambiguous").when(margin < b["a_assignment_margin"], "ambiguous").otherwise("assigned")
    )
    a = a.withColumns({"margin": margin, "weight": weight, "runner_up": F.col("_next.c"), "runner_up_score": -F.col("_next.s"), "recipient_assignment": label})
    return a.select("call_id", *(b[c].alias(c) for c in cands.columns if c != "call_id"), "margin", "weight", "runner_up", "runner_up_score", "recipient_assignment")


def reclassified(calls: DataFrame) -> DataFrame:
    """Classes after assignment. They start from class_group and copy_state_group, so a second run changes nothing."""
    d = F.coalesce(F.col("donor_residual") > F.col("a_donor_mod"), F.lit(False))
    lost = F.coalesce(F.col("strong") & (F.col("lower") >= F.col("a_loss_depletion")), F.lit(False))
    fits = F.coalesce((F.col("overlap") >= 0.5) & F.col("width_ratio").between(0.5, 2.0), F.lit(False))
    tg, tl = F.coalesce(F.col("total_residual") > F.col("a_total_mod"), F.lit(False)), F.coalesce(F.col("total_residual") < -F.col("a_total_mod"), F.lit(False))
    sure = F.when(F.coalesce(F.col("donor_residual") >= 1, F.lit(False)), "high").otherwise("moderate")
    rows: list[tuple[Column, str, str, Column, str]] = [
        (d & lost & ~fits, "complex", "donor+recipient; width mismatch", F.lit("low"), "compound"),
        (d & lost & (tg | tl), "complex", "donor+recipient; total imbalance", F.lit("low"), "compound"),
        (d & lost, "substitution", "donor+recipient", sure, "balanced"),
        (d & tl, "complex", "donor; total loss", F.lit("low"), "compound"),
        (d, "addition", "donor", sure, "gain"),
        (lost & tg, "complex", "recipient; total gain", F.lit("low"), "compound"),
        (lost, "deletion", "recipient", F.when(tl, "high").otherwise("moderate"), "loss"),
    ]
    assigned = F.coalesce(F.col("recipient_assignment") == "assigned", F.lit(False))
    cls, ev, conf, state = F.col("class_group"), F.col("evidence"), F.col("class_confidence"), F.col("copy_state_group")
    for cond, name, text, how, copies in reversed(rows):
        hit = assigned & cond
        cls, ev, conf, state = F.when(hit, name).otherwise(cls), F.when(hit, text).otherwise(ev), F.when(hit, how).otherwise(conf), F.when(hit, copies).otherwise(state)
    hosted = F.coalesce(F.col("recipient_assignment") != "no_recipient_loss", F.lit(False))
    total = F.when(~hosted, F.col("total_evidence")).when(tg, "gain").when(tl, "loss").when(F.col("total_residual").isNotNull() & F.col("a_total_mod").isNotNull(), "neutral")
    low = F.when(hosted & F.coalesce(F.col("recipient_mapq_fraction") < 0.5, F.lit(False)), "low").otherwise(F.col("mappability_status"))
    c = calls.withColumns({"_c": cls, "_e": ev, "_f": conf, "_s": state, "_t": total, "mappability_status": low, "_hit": assigned & (d | lost)})
    status = F.when(F.col("recipient_assignment") == "cross_group", "needs_review").when(F.col("_hit"), F.when(F.col("_f") == "high", "confident").when(F.col("_f") == "low", "needs_review").otherwise("ambiguous")).otherwise(F.col("class_status"))
    c = c.withColumn("_u", status)
    down = hosted & (F.col("_f") == "high") & ((F.col("component_status") == "heterogeneous") | F.coalesce(F.col("mappability_status") == "low", F.lit(False)))
    c = c.withColumn("_down", down)
    c = c.withColumns({"class_status": F.when(F.col("_down"), "ambiguous").otherwise(F.col("_u")), "class_confidence": F.when(F.col("_down"), "moderate").otherwise(F.col("_f")), "class": F.col("_c"), "evidence": F.col("_e"), "copy_state": F.col("_s"), "total_evidence": F.col("_t")})
    return c.drop("_c", "_e", "_f", "_s", "_t", "_u", "_hit", "_down")


#: Columns of a call that assignment writes: name -> column of the chosen candidate.
HOST = {
    "recipient_chr": "chr_id", "recipient_group": "grp", "recipient_start_iid": "run_start_iid", "recipient_end_iid": "run_end_iid", "recipient_start_bp": "inside_start_bp", "recipient_end_bp": "inside_end_bp",
    "recipient_run_start_bp": "run_start_bp", "recipient_run_end_bp": "run_end_bp", "recipient_expected_breadth": "expected_breadth", "recipient_observed_breadth": "observed_breadth", "recipient_mapq_fraction": "mapq_fraction",
    "recipient_mean_depletion": "mean", "recipient_depletion_se": "se", "recipient_depletion_lower": "lower", "recipient_depletion_z": "z", "recipient_width_overlap": "overlap", "recipient_fraction_ratio": "width_ratio",
    "recipient_reliable": "reliable", "recipient_strong": "strong", "assignment_score": "score", "assignment_margin": "margin",
}


def assign_hosts(calls: DataFrame, residuals: DataFrame, n: int, params: Params = Params(), null: DataFrame | None = None, cutoffs: DataFrame | None = None) -> DataFrame:
    """Calls with their host contig, label and class after assignment; without a host no_recipient_loss and weight 0.

    ``null`` (of ``null_thresholds``) and ``cutoffs`` replace the parameters' thresholds by (mode, bin). Calls without any candidate stay.
    """
    made = [*HOST, "recipient_deletion_width_bp", "recipient_cross_group", "assignment_weight", "runner_up", "runner_up_score", "recipient_assignment"]
    base = with_thresholds(calls.drop(*[c for c in made if c in calls.columns]), params, null, cutoffs)
    cands = candidates(base, residuals, n, params)
    best = labelled(cands, match_hosts(cands, calls))
    take = best.select(
        "call_id", *(F.col(c).alias(name) for name, c in HOST.items()), F.when(F.col("run_found"), F.col("run_width_bp")).alias("recipient_deletion_width_bp"), F.coalesce(~F.col("same_group"), F.lit(False)).alias("recipient_cross_group"),
        F.col("weight").alias("assignment_weight"), "runner_up", "runner_up_score", "recipient_assignment", "strong", "lower", "overlap", "width_ratio",
    )
    j = base.join(take, "call_id", "left").withColumns({"recipient_assignment": F.coalesce("recipient_assignment", F.lit("no_recipient_loss")), "assignment_weight": F.coalesce("assignment_weight", F.lit(0.0)), "recipient_cross_group": F.coalesce("recipient_cross_group", F.lit(False))})
    out = reclassified(j)
    return out.drop("strong", "lower", "overlap", "width_ratio", *(f"a_{t}" for t in THRESHOLDS), "a_donor_mod", "a_loss_depletion", "a_total_mod")
