"""Exports of results."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covertile.functions import safe_name
from covertile.operators.explore import confident, review
from covertile.schemas import conform, ordered, struct

#: The export's columns (fixed names, fixed order): name -> column of a call.
BEDPE_COLUMNS = {
    "sample": "sample", "chr_id.don": "chrom1", "start.don": "start1", "stop.don": "end1", "chr_id.rec": "chrom2", "start.rec": "start2", "stop.rec": "end2", "width_bp": "width_bp",
    "score_mean": "score_mean", "donor_mean": "donor_residual", "recipient_mean": "recipient_residual", "class": "class", "class_group": "class_group", "class_evidence": "evidence", "class_confidence": "class_confidence", "class_status": "class_status",
    "copy_state": "copy_state", "total_evidence": "total_evidence", "component_status": "component_status", "mappability_status": "mappability_status", "mapq_fraction": "mapq_high_fraction", "confidence": "confidence", "method": "method", "mode": "mode", "group": "grp",
    "start_iid": "start_iid", "end_iid": "end_iid", "pass": "pass", "recipient_component": "recipient_component", "recipient_chr_name": "recipient_chr", "recipient_group": "recipient_group", "recipient_assignment": "recipient_assignment",
    "recipient_cross_group": "recipient_cross_group", "recipient_weight": "assignment_weight", "recipient_expected_breadth": "recipient_expected_breadth", "recipient_observed_breadth": "recipient_observed_breadth",
    "recipient_deletion_width_bp": "recipient_deletion_width_bp", "recipient_alternative": "runner_up", "recipient_mean_depletion": "recipient_mean_depletion", "recipient_depletion_se": "recipient_depletion_se", "recipient_depletion_lower": "recipient_depletion_lower",
    "recipient_depletion_z": "recipient_depletion_z", "recipient_width_overlap": "recipient_width_overlap", "recipient_fraction_ratio": "recipient_fraction_ratio", "recipient_mapq_fraction": "recipient_mapq_fraction", "total_mean": "total_residual",
    "donor_component": "donor_component", "donor_chr_name": "donor_chr",
}
#: Descriptive names of the interval columns (fixed names).
BEDPE_ALIASES = {"chr_id.don": "donor_contig_id", "start.don": "donor_start_bp", "stop.don": "donor_end_bp", "chr_id.rec": "recipient_contig_id", "start.rec": "recipient_start_bp", "stop.rec": "recipient_end_bp"}
_LONGS = ("start1", "end1", "start2", "end2", "width_bp", "start_iid", "end_iid")
_TEXTS = (
    "sample", "chrom1", "chrom2", "class", "class_group", "evidence", "class_confidence", "class_status", "copy_state", "total_evidence", "component_status", "mappability_status", "confidence", "method", "mode", "grp", "recipient_component",
    "recipient_chr", "recipient_group", "recipient_assignment", "runner_up", "donor_component", "donor_chr",
)
BEDPE = struct(", ".join(f"{c} {'bigint' if c in _LONGS else 'boolean' if c in ('pass', 'recipient_cross_group') else 'string' if c in _TEXTS else 'double'}" for c in BEDPE_COLUMNS.values()))
#: Names of exported columns (fixed names).
QC_NAMES = {
    "metrics": {
        "sample": "sample_name", "chr_id": "contig_id", "chr_name": "contig_name", "grp": "chromosome_group", "iid": "window_index", "start": "start_bp", "stop": "end_bp", "length": "window_length_bp", "count": "read_count", "covered": "covered_bases",
        "mapq_high": "high_mapq_read_count", "mapq_high_fraction": "high_mapq_read_fraction", "gc": "gc_fraction", "read_length": "read_length_bp",
    },
    "scores": {
        "sample": "sample_name", "grp": "chromosome_group", "iid": "window_index", "start": "start_bp", "stop": "end_bp", "score": "introgression_score", "score_raw": "raw_introgression_score", "donor_mean": "mean_donor_coverage", "recipient_mean": "mean_recipient_coverage",
        "n_donor": "n_donor_contigs", "n_recipient": "n_recipient_contigs", "donor_spread": "donor_component_spread", "recipient_spread": "recipient_component_spread", "supported_donors": "supporting_donor_contigs", "mapq_high_fraction": "high_mapq_read_fraction",
        "gc_donor": "donor_gc_fraction", "gc_recipient": "recipient_gc_fraction", "log_donor": "log_donor_coverage", "log_recipient": "log_recipient_coverage", "log_total": "log_total_coverage", "total_residual": "total_depth_residual",
    },
    "masks": {"grp": "chromosome_group", "iid": "window_index", "start": "start_bp", "stop": "end_bp", "f": "mask_signal", "posterior": "mask_posterior", "mask": "masked", "source": "mask_source"},
    "calibration": {"mode": "analysis_mode", "length_bin": "call_length_bin", "n_control": "control_calls", "q99": "null_q99", "threshold": "calibration_threshold", "fdr": "target_fdr"},
}
#: Columns that a table of calls, or of samples, shows at first (fixed choices).
BRIEF_CALLS = ["grp", "class", "copy_state", "class_status", "recipient_chr", "donor_chr", "recipient_assignment", "start_bp", "end_bp", "width_bp", "pass"]
BRIEF_SAMPLES = ["sample", "n_windows", "donor_reads", "recipient_reads", "reads", "n_calls", "n_high_confidence", "masked_fraction"]


def brief_calls(calls: DataFrame) -> DataFrame:
    """The columns that answer what was found and where; with the sample if there are several."""
    several = calls.select("sample").distinct().limit(2).count() > 1
    return calls.select(*(["sample"] if several else []), *(c for c in BRIEF_CALLS if c in calls.columns))


def extra_columns(df: DataFrame, brief: list[str]) -> list[str]:
    """What can be added to a brief table, in the table's order."""
    return [c for c in df.columns if c not in brief and c != "sample"]


def dictionary(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(place, column, export_name, type): what an exported table's columns are called."""
    rows = [(i, f.name, names.get(f.name, f.name), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, column string, export_name string, type string")


def write_calls(calls: DataFrame, folder: str) -> None:
    """CSV folders all, passing, confident and review (all that is not confident), in the order of calls."""
    flat = ordered(calls, "calls").persist()
    try:
        for name, part in (("all", flat), ("passing", flat.filter("pass")), ("confident", confident(flat)), ("review", review(flat))):
            part.write.mode("overwrite").csv(f"{folder}/calls_{name}", header=True, nullValue="")
    finally:
        flat.unpersist()


def annotated(calls: DataFrame, windows: DataFrame) -> DataFrame:
    """Calls with donor and recipient intervals: of the donor's component (else the first), of the first recipient component,
    of the assigned contig where there is one; none without a host. Joins are on start_iid and end_iid."""
    w = windows.select("role", "grp", "component", "chr_id", "iid", "start", "stop")
    first = Window.partitionBy("role", "grp").orderBy("component", "chr_id")
    names = w.select("role", "grp", "component", "chr_id").distinct().withColumn("_r", F.row_number().over(first))
    d = names.filter("role = 'donor'").select("grp", F.col("component").alias("_dc"), F.col("chr_id").alias("donor_chr"), "_r")
    j = calls.join(d, (calls["grp"] == d["grp"]) & (F.coalesce(d["_dc"] == calls["donor_component"], F.lit(False)) | (d["_r"] == 1)), "left").drop(d["grp"])
    pick = Window.partitionBy("sample", "grp", "start_iid", "end_iid").orderBy(F.desc(F.coalesce(F.col("_dc") == F.col("donor_component"), F.lit(False))), "_r")
    j = j.withColumn("_k", F.row_number().over(pick)).filter("_k = 1").drop("_k", "_dc", "_r")
    r = names.filter("role = 'recipient' and _r = 1").select("grp", F.col("chr_id").alias("_rc"))
    j = j.join(r, "grp", "left")
    hostless = F.coalesce(F.col("recipient_assignment") == "no_recipient_loss", F.lit(False))
    j = j.withColumns({"recipient_chr": F.when(~hostless, F.coalesce("recipient_chr", "_rc")), "_rs": F.coalesce("recipient_start_iid", "start_iid"), "_re": F.coalesce("recipient_end_iid", "end_iid")})
    at = w.select("chr_id", "iid", "start", "stop")
    for chrom, lo, hi, out in (("donor_chr", "start_iid", "end_iid", "1"), ("recipient_chr", "_rs", "_re", "2")):
        a = at.select(F.col("chr_id").alias(chrom), F.col("iid").alias(lo), F.col("start").alias(f"start{out}"))
        b = at.select(F.col("chr_id").alias(chrom), F.col("iid").alias(hi), F.col("stop").alias(f"end{out}"))
        j = j.join(a, [chrom, lo], "left").join(b, [chrom, hi], "left")
    return j.drop("_rc", "_rs", "_re")


def label() -> Column:
    return F.concat_ws("|", "class", "class_status", F.when(F.col("pass"), "pass").otherwise("fail"))


def interval_rows(calls: DataFrame, windows: DataFrame, samples: list[str] = (), ids: DataFrame | None = None, pass_only: bool = False) -> DataFrame:
    """Chosen calls with chrom1, start1, end1 (donor), chrom2, start2, end2 (recipient), name."""
    c = calls.filter(F.col("sample").isin(*samples)) if samples else calls
    c = c.filter("pass") if pass_only else c
    c = c if ids is None else c.join(ids, "call_id", "left_semi")
    return annotated(c, windows).withColumns({"chrom1": F.col("donor_chr"), "chrom2": F.col("recipient_chr"), "name": label()})


def bedpe(calls: DataFrame, windows: DataFrame, samples: list[str] = (), ids: DataFrame | None = None, pass_only: bool = False, descriptive: bool = False) -> DataFrame:
    """The export's 48 columns under their names; missing ones are NULL. ``descriptive``: with the interval columns' long names."""
    rows = conform(interval_rows(calls, windows, samples, ids, pass_only), BEDPE, {"method": "cbs"})
    names = {k: BEDPE_ALIASES.get(k, k) if descriptive else k for k in BEDPE_COLUMNS}
    return rows.select(*(F.col(c).alias(names[k]) for k, c in BEDPE_COLUMNS.items()))


def bed(bedpe_rows: DataFrame, side: int) -> DataFrame:
    """(line) of BED: side 1 donor, 2 recipient; only finite, non-empty intervals."""
    b = bedpe_rows.filter(F.col(f"chrom{side}").isNotNull() & (F.col(f"end{side}") > F.col(f"start{side}")))
    return b.select(F.concat_ws("\t", f"chrom{side}", F.col(f"start{side}").cast("string"), F.col(f"end{side}").cast("string"), "name", F.lit("0"), F.lit(".")).alias("line"))


def mask_bed(masks: DataFrame, grid: DataFrame) -> DataFrame:
    """(line): masked windows; the score is the posterior in 0..1000, rounded half to even."""
    m = masks.filter("mask").join(grid.select("grp", "iid", "start", "stop"), ["grp", "iid"])
    score = F.greatest(F.lit(0), F.least(F.lit(1000), F.rint(F.col("posterior") * 1000).cast("int")))
    return m.select(F.concat_ws("\t", F.concat(F.lit("group_"), "grp"), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("mask"), score.cast("string"), F.lit(".")).alias("line"))


def bedgraph(metrics: DataFrame) -> DataFrame:
    """(sample, chr_id, start, stop, breadth) with six decimals; write as gzip CSV by sample."""
    return metrics.select("sample", "chr_id", "start", "stop", F.format_string("%.6f", "breadth").alias("breadth"))


def write_tracks(calls: DataFrame, windows: DataFrame, masks: DataFrame, grid: DataFrame, metrics: DataFrame, folder: str) -> None:
    bedpe(calls, windows).write.mode("overwrite").csv(f"{folder}/calls_bedpe", sep="\t", header=True, nullValue="")
    bedpe_rows = interval_rows(calls, windows)
    for side, name in ((1, "donor"), (2, "recipient")):
        bed(bedpe_rows, side).write.mode("overwrite").text(f"{folder}/calls_{name}_bed")
    mask_bed(masks, grid).write.mode("overwrite").text(f"{folder}/masks_bed")
    bedgraph(metrics).write.mode("overwrite").partitionBy("sample").csv(f"{folder}/breadth_bedgraph", sep="\t", compression="gzip")


def write_qc(tables: dict[str, DataFrame], folder: str) -> None:
    """QC tables under their export names, checked before anything is written."""
    from covertile.schemas import validate

    validate(tables, {k: v for k, v in {"metrics": {"sample", "chr_id", "iid"}, "scores": {"sample", "grp", "iid"}, "masks": {"grp", "iid", "mask"}, "calibration": {"mode", "bin"}}.items() if k in tables})
    for name, df in tables.items():
        out = df.withColumnsRenamed({k: v for k, v in QC_NAMES.get(name, {}).items() if k in df.columns})
        out.write.mode("overwrite").csv(f"{folder}/{name}", header=True, compression="gzip", nullValue="")


def sample_folders(samples: DataFrame, reserved: list[str] = ("run", "qc")) -> DataFrame:
    """(sample, folder): safe names, told apart by a number where they agree without case, are reserved, or where the numbered name is another's own."""
    s = samples.select("sample").distinct().withColumn("_f", F.coalesce(F.nullif(safe_name("sample"), F.lit("")), F.lit("sample")))
    n = F.row_number().over(Window.partitionBy(F.lower("_f")).orderBy("sample"))
    n = n + F.lower("_f").isin(*reserved).cast("int") if reserved else n
    s = s.withColumn("_n", n)
    # a numbered name gets a separator that no safe name of its own can end in, if somebody is called so
    own = s.filter("_n = 1").select(F.lower("_f").alias("_k"), F.lit(True).alias("_own"))
    s = s.withColumn("_m", F.concat_ws("-", "_f", F.col("_n").cast("string"))).join(own, F.lower("_m") == F.col("_k"), "left")
    name = F.when(F.col("_n") == 1, F.col("_f")).when(F.col("_own"), F.concat("_m", F.lit("-"))).otherwise(F.col("_m"))
    return s.select("sample", name.alias("folder"))


def write_by_sample(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables with a sample in a folder for each sample, others whole. The folders' names are safe ones (``sample_folders``)."""
    for name, df in tables.items():
        if "sample" in df.columns:
            dirs = sample_folders(df)
            df.join(F.broadcast(dirs), "sample").write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_alignments(lines: DataFrame, targets: DataFrame, folder: str) -> None:
    """Alignment lines (value) as text files, each sorted by contig and position and with its own header.

    ``targets`` (name, length, ord) are the contigs in order, a row each, small enough for one header. Files follow one another by ranges
    of contig and position; lines of other contigs come last.
    """
    names = targets.orderBy("ord").select("name", "length").collect()
    head = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{t['name']}\tLN:{t['length']}" for t in names)]
    p = F.split("value", "\t")
    placed = lines.select("value", p[2].alias("name"), p[3].cast("long").alias("_pos")).join(targets.select("name", F.col("ord").alias("_ord")), "name", "left")
    placed = placed.withColumn("_ord", F.coalesce(F.col("_ord").cast("long"), F.lit((1 << 63) - 1)))

    def with_header(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        for b in batches:
            # named anew, since batches with and without nulls would have two schemas
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    placed.repartitionByRange("_ord", "_pos").sortWithinPartitions("_ord", "_pos", "value").select("value").mapInArrow(with_header, "value string").write.mode("overwrite").text(folder)


def run_metadata(spark: SparkSession, provenance: dict, folder: str, tables: dict[str, DataFrame] | None = None) -> None:
    """One JSON row of provenance, a table of its scalar parameters, and the given tables (assembly, samples, inputs)."""
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True, nullValue="")
    import json

    row = spark.createDataFrame([(json.dumps(provenance, sort_keys=True, default=str),)], "json string")
    row.write.mode("overwrite").text(f"{folder}/provenance")
    scalars = [(k, str(v)) for k, v in sorted(provenance.items()) if isinstance(v, (str, int, float, bool))]
    spark.createDataFrame(scalars, "parameter string, value string").write.mode("overwrite").csv(f"{folder}/parameters", header=True)


def manifest(spark: SparkSession, folder: str, buffer: int = 8 << 20) -> DataFrame:
    """(path, bytes, md5) of every file under ``folder``, in order of paths; names that begin with a dot or underscore aren't listed.

    Paths are listed without the content (Spark's index of the folder, which the driver holds anyway; a scan would leave empty files out),
    so a file may be of any size; each is then read in pieces of ``buffer`` bytes by the task that hashes it. No folder of that
    name, or a file gone meanwhile, is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()

    def hashed(batches):
        from pyarrow import fs

        for batch in batches:
            sizes, digests = [], []
            for path in batch.column("path").to_pylist():
                # listed local paths come as file:/a or file:///a
                local = re.fullmatch(r"file:/+(.*)", path, re.S)
                store, place = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
                digest, size = hashlib.md5(), 0
                with store.open_input_stream(place) as stream:
                    while piece := stream.read(buffer):
                        digest.update(piece)
                        size += len(piece)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "bytes", "md5"])

    listed = spark.createDataFrame([(unquote(f),) for f in files], "path string").repartition("path")
    return listed.mapInArrow(hashed, "path string, bytes long, md5 string").orderBy("path")
