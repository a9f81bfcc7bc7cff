"""Classes, copy states, confidence and status of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.operators.calibrate import CUTOFFS, default_cutoffs
from covertile.params import Params

SUPPORTED = 0.5


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def signals() -> dict[str, Column]:
    """What the residuals say: donor gain, recipient loss and gain, total gain and loss."""
    d, r, t = F.col("donor_residual"), F.col("recipient_residual"), F.col("total_residual")
    return {
        "gain": _yes(d > F.col("donor_mod")), "loss": _yes(r < F.col("loss_mod")), "rgain": _yes(r > F.abs("loss_mod")),
        "tgain": _yes(t > F.col("total_mod")), "tloss": _yes(t < -F.col("total_mod")),
    }


def component_status(columns: list[str]) -> Column:
    """heterogeneous if a side's components spread over 2 or several donors support the call; what is not there counts 0."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in columns else F.lit(0.0)
    return F.when((n("donor_spread") > 2) | (n("recipient_spread") > 2) | (n("supported_donors") > 1), "heterogeneous").otherwise("consistent")


def mappability_status(fraction: str = "mapq_high_fraction") -> Column:
    return F.when(F.col(fraction) < SUPPORTED, "low").when(F.col(fraction) >= SUPPORTED, "ok")


def downgrade(df: DataFrame) -> DataFrame:
    """High confidence with mixed components or low mappability becomes moderate, and ambiguous."""
    down = (F.col("class_confidence") == "high") & ((F.col("component_status") == "heterogeneous") | _yes(F.col("mappability_status") == "low"))
    return df.withColumn("_down", down).withColumns({"class_confidence": F.when(F.col("_down"), "moderate").otherwise(F.col("class_confidence")), "class_status": F.when(F.col("_down") & (F.col("class_status") == "confident"), "ambiguous").otherwise(F.col("class_status"))}).drop("_down")


def status_of(confidence: str = "class_confidence") -> Column:
    return F.when(~_yes(F.col("pass")), "needs_review").when(F.col(confidence) == "high", "confident").when(F.col(confidence) == "moderate", "ambiguous").otherwise("needs_review")


def classify(calls: DataFrame, params: Params = Params(), cutoffs: DataFrame | None = None) -> DataFrame:
    """Calls (with residuals, pass, mode, bin) with class, copy_state, total_evidence, evidence, confidences and statuses.

    Cutoffs of (mode, bin) come by a broadcast join of a few rows; where there are none the parameters hold. Cases: a NULL
    residual supports nothing; without donor or recipient residual the class confidence is low; a NULL pass fails.
    """
    c = calls.drop(*CUTOFFS)
    if cutoffs is not None:
        few = cutoffs.select("mode", F.col("bin").alias("_bin"), *CUTOFFS)
        c = c.withColumn("_bin", F.coalesce("bin", F.lit(-1))).join(F.broadcast(few), ["mode", "_bin"], "left").drop("_bin")
    c = default_cutoffs(c, params).withColumns({f"_{k}": v for k, v in signals().items()})
    gain, loss, rgain, tgain, tloss = (F.col(f"_{k}") for k in ("gain", "loss", "rgain", "tgain", "tloss"))
    d, r, t = F.col("donor_residual"), F.col("recipient_residual"), F.col("total_residual")
    both, donor_only, loss_only = gain & loss, gain & ~loss, ~gain & loss
    # a total that contradicts the sides, or a gain on both, is a compound event
    compound = (both & (tgain | tloss)) | (donor_only & tloss) | (loss_only & tgain) | (gain & rgain)
    plain = F.when(both, "substitution").when(gain, "addition").when(loss, "deletion").otherwise("other")
    text = F.when(compound & both, "donor+recipient; total imbalance").when(compound, "total imbalance").when(gain & (loss | rgain), "donor+recipient").when(gain, "donor").when(loss | rgain, "recipient").otherwise("none")
    total = F.when(tgain, "gain").when(tloss, "loss").when(t.isNotNull(), "neutral")
    c = c.withColumns({"compound": compound, "class": F.when(compound, "complex").otherwise(plain), "evidence": text, "total_evidence": total})
    imbalanced = (F.col("class") == "other") & (tgain | tloss)
    state = (
        F.when(compound, "compound").when(donor_only, "gain").when(loss_only, "loss").when(imbalanced & tgain, "gain").when(imbalanced, "loss")
        .when(both, "balanced").otherwise("neutral")
    )
    high = (
        F.when(compound, False).when(both, (d >= F.col("donor_high")) & (r <= F.col("loss_mod")) & ~tgain & ~tloss)
        .when(donor_only, (d >= F.col("donor_high")) & (t.isNull() | (t >= 0) | (t >= F.col("total_high"))))
        .when(loss_only, (r <= F.col("loss_high")) & (t.isNull() | (t <= -F.col("total_high")))).otherwise(False)
    )
    confidence = F.when(d.isNull() | r.isNull(), "low").when(_yes(F.col("pass")) & _yes(high), "high").when(compound | gain | loss, "moderate").otherwise("low")
    effect = F.when(_yes(F.col("pass")) & (d >= params.donor_high), "high").when(d >= params.donor_mod, "moderate").otherwise("low")
    c = c.withColumns({"class_confidence": confidence, "copy_state": state, "confidence": effect})
    status = F.when(F.col("compound"), "needs_review").when(imbalanced, "ambiguous").otherwise(status_of())
    c = c.withColumns({"class_status": status, "component_status": component_status(c.columns), "mappability_status": mappability_status(), "class_group": F.col("class"), "copy_state_group": F.col("copy_state")})
    return downgrade(c).drop(*(f"_{k}" for k in ("gain", "loss", "rgain", "tgain", "tloss")))


def donor_supported() -> Column:
    return F.when(F.col("evidence").isNotNull(), F.contains("evidence", F.lit("donor"))).otherwise(F.col("class").isin("addition", "substitution", "complex"))


def recipient_supported() -> Column:
    return F.when(F.col("evidence").isNotNull(), F.contains("evidence", F.lit("recipient"))).otherwise(F.col("class").isin("deletion", "substitution", "complex"))
