"""The whole analysis from alignments to assigned calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.operators import assign, calibrate, classify, evidence, mask, metrics, reads, robust, scoring, segment, tiling
from covertile.params import Params
from covertile.plans.tables import saved
from covertile.schemas import ordered, validate


def measure(alignments: DataFrame, targets: DataFrame, n: int, min_mapq: int = 0, count_deletions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts, read lengths): every window of every sample, and the aligned bases of each sample's first read. Alignments have a sample."""
    windows = tiling.tile(targets, n)
    place = targets.select(F.col("id").alias("chr_id"), "length", "ord") if "ord" in targets.columns else targets.select(F.col("id").alias("chr_id"), "length", F.lit(0).alias("ord"))
    pieces = reads.in_windows(reads.blocks(reads.passing(alignments, min_mapq), count_deletions), place.drop("ord"), n)
    counts = reads.on_grid(reads.count_windows(pieces), windows.withColumn("chr_id", F.col("id")), alignments.select("sample"))
    return counts, reads.read_length(pieces.join(F.broadcast(place.select("chr_id", "ord")), "chr_id"))


def corrected(scores: DataFrame, cohort: bool) -> DataFrame:
    """Scores with donor, recipient and total residuals: polished over the cohort, or regressed on GC for a single sample.

    The corrected score is the donor's residual less the recipient's; score_raw stays as it was.
    """
    out = scores
    pairs = (("log_donor", "donor_residual"), ("log_recipient", "recipient_residual"), ("log_total", "total_residual"))
    for source, name in pairs:
        if cohort:
            r = robust.median_polish(out.select("sample", "grp", "iid", F.col(source).alias(name)), ["grp", "iid"], "sample", name)
        else:
            gc = ["gc_donor"] if name == "donor_residual" else ["gc_recipient"] if name == "recipient_residual" else ["gc_donor", "gc_recipient"]
            r = robust.gc_regression(out.select("sample", "grp", "iid", source, *gc), ["sample"], source, gc).select("sample", "grp", "iid", F.col("residual").alias(name))
        out = out.join(r, ["sample", "grp", "iid"])
    return out.withColumn("score", F.coalesce(F.col("donor_residual") - F.col("recipient_residual"), F.col("score")))


def analyze(
    alignments: DataFrame, targets: DataFrame, n: int | None = None, gc: DataFrame | None = None, params: Params = Params(), controls: DataFrame | None = None, composition: dict[str, float] | None = None,
    read_groups: DataFrame | None = None, read_length: float | None = None, permutations: int = 64, progress: Callable[[str], None] = lambda stage: None,
) -> dict[str, DataFrame]:
    """All tables of a result: windows, metrics, scores, masks, calibration, cutoffs, null, calls, components.

    ``alignments``: read, sample (or rg, with ``read_groups``), rname, pos, mapq, flag, cigar; ``targets``: id, role, name, grp, component, copy_number,
    length. ``n`` windows a contig (the parameters' if not given); ``composition`` overrides copy numbers by component; the read
    length is measured unless given. Metrics, scores and segments are read several times, so they are written once.
    """
    n = n or params.windows
    progress("windows")
    t = targets.withColumns({"chr_id": F.col("id"), "chr_name": F.col("name")})
    windows = tiling.tile(t, n)
    progress("measure")
    rows = alignments if read_groups is None else reads.with_sample(alignments, read_groups)
    counted, lengths_of_reads = measure(rows, t, n, params.min_mapq)
    counts = counted.select("sample", "chr_id", "iid", "count", "mapq_high", "covered")
    m = saved(metrics.window_metrics(counts, windows, gc, read_length if read_length is not None else saved(lengths_of_reads)))
    seen = metrics.run_coverage(m).first()
    if seen["empty_samples"]:
        raise ValueError(f"sample without coverage: {seen['first_empty']}")
    cohort = seen["samples"] > 1
    mode = "multi" if cohort else "single"
    progress("scores")
    raw = scoring.score_pairs(m, params, scoring.composition(m, composition))
    raw = raw.join(scoring.spread(m, "donor", params), ["sample", "grp", "iid"], "left").join(scoring.spread(m, "recipient", params), ["sample", "grp", "iid"], "left")
    scores = saved(scoring.group_coordinates(corrected(saved(raw), cohort), m, n))
    progress("mask")
    masks = saved(mask.recurrence_mask(scores, m, params.mask_z))
    masked = saved(mask.apply_mask(scores, masks))
    progress("segments")
    lengths = t.filter("role = 'donor'").groupBy("grp").agg(F.max("length").alias("length"))
    segs = saved(segment.call_segments(masked, lengths, n, params))
    progress("calls")
    table = saved(calibrate.calibration(segs, params, mode, controls))
    passed = calibrate.passing(segs, table, params, mode)
    cuts = saved(calibrate.cutoffs(passed, params, controls))
    calls = classify.classify(passed, params, cuts)
    calls = evidence.dominant_component(calls, masked)
    calls = saved(calls.withColumn("call_id", F.concat_ws("_", "sample", "grp", F.col("start_iid").cast("string"), F.col("end_iid").cast("string"))))
    progress("assign")
    residuals = saved(assign.recipient_residuals(m, params, masks, cohort))
    null = saved(assign.null_thresholds(calls, assign.null_profile(residuals, controls), n, permutations, bonus=params.same_group_bonus))
    final = saved(ordered(assign.assign_hosts(calls, residuals, n, params, null, cuts), "calls"))
    result = {"windows": windows, "metrics": m, "scores": masked, "masks": masks, "calibration": table, "cutoffs": cuts, "null": null, "calls": final, "components": evidence.component_evidence(final, m, masked, params)}
    validate(result)
    return result
