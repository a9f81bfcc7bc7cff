"""Filters over finished calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def display_group(df: DataFrame) -> DataFrame:
    """Calls across groups show in their recipient's group."""
    cross = (F.col("recipient_assignment") == "cross_group") & (F.coalesce("recipient_group", F.lit("")) != "")
    return df.withColumn("display_group", F.when(cross, F.col("recipient_group")).otherwise(F.col("grp")))


def unplaced() -> Column:
    return F.coalesce(F.col("recipient_assignment") == "no_recipient_loss", F.lit(False))


def explorer_filter(calls: DataFrame, pass_only: bool = False, groups: list[str] = (), classes: list[str] = (), statuses: list[str] = (), copy_states: list[str] = (), confidences: list[str] = (), min_width: int = 0, show_unplaced: bool = True) -> DataFrame:
    """A conjunction of choices; an empty list chooses everything; a group is met by the call's own or its display group."""
    out = display_group(calls)
    if pass_only:
        out = out.filter(F.coalesce("pass", F.lit(False)))
    if groups:
        out = out.filter(F.col("grp").isin(*groups) | F.col("display_group").isin(*groups))
    for name, chosen in (("class", classes), ("class_status", statuses), ("copy_state", copy_states), ("class_confidence", confidences)):
        if chosen:
            out = out.filter(F.col(name).isin(*chosen))
    if min_width:
        out = out.filter(F.col("width_bp") >= min_width)
    return out if show_unplaced else out.filter(~unplaced())


def rendered(calls: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Calls whose id is in ``ids``; None passes all, an empty table none."""
    return calls if ids is None else calls.join(ids.select("call_id").distinct(), "call_id", "left_semi")


def confident(calls: DataFrame) -> DataFrame:
    """Passing calls of confident status (high confidence where there is no status)."""
    sure = F.coalesce(F.col("class_status") == "confident", F.col("class_confidence") == "high", F.lit(False))
    return calls.filter(F.coalesce("pass", F.lit(False)) & sure)


def review(calls: DataFrame) -> DataFrame:
    sure = F.coalesce("pass", F.lit(False)) & F.coalesce(F.col("class_status") == "confident", F.col("class_confidence") == "high", F.lit(False))
    return calls.filter(~sure)


def alternatives(calls: DataFrame) -> DataFrame:
    """Calls that have a named runner-up."""
    return calls.filter(F.coalesce("runner_up", F.lit("")) != "")


def full_chromosome(calls: DataFrame, lengths: DataFrame, share: float = 0.95, fallback: DataFrame | None = None) -> DataFrame:
    """Passing calls from the first window on that cover at least ``share`` of their contig (grp, length).

    A substitution counts by the width of its recipient's deletion, where known. ``fallback`` (grp, length), the scores' own
    lengths, serves groups that ``lengths`` lacks.
    """
    j = calls.filter("pass and start_iid = 0").join(lengths.select("grp", F.col("length").alias("_l")), "grp", "left")
    if fallback is not None:
        j = j.join(fallback.select("grp", F.col("length").alias("_f")), "grp", "left").withColumn("_l", F.coalesce("_l", "_f")).drop("_f")
    own = next((c for c in ("recipient_deletion_width_bp", "recipient_width_bp") if c in calls.columns), None)
    wide = F.when(F.col("class") == "substitution", F.coalesce(own, "width_bp")).otherwise(F.col("width_bp")) if own else F.col("width_bp")
    return j.filter(wide / F.col("_l") >= share).drop("_l")
