"""Alignments from SAM text, headers, contig lists, sequences, saved results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covertile.functions import stem
from covertile.plans.tables import saved


def sam_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): lines of SAM text files, without carriage returns."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))


def alignments(lines: DataFrame) -> DataFrame:
    """Reads (path, read, qname, flag, rname, pos 0-based, mapq, cigar, rg) of alignment lines.

    ``read`` is a key made from the line, as SAM has none; equal lines of a file share it. Fields are split by a generator, which filters
    on the reads don't pass, so a line is made and split once, not once for each condition.
    """
    p = F.col("_p")
    rows = lines.select("path", "value", F.explode(F.array(F.split("value", "\t", 12))).alias("_p")).filter(~F.startswith(p[0], F.lit("@")) & (F.size(p) >= 11))
    rg = F.nullif(F.regexp_extract("value", r"\tRG:Z:([^\t]*)", 1), F.lit(""))
    return rows.select(
        "path", F.xxhash64("path", "value").alias("read"), p[0].alias("qname"), p[1].cast("int").alias("flag"), p[2].alias("rname"), (p[3].cast("long") - 1).alias("pos"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), rg.alias("rg"),
    )


def _tags(line: Column) -> Column:
    """The TAG:value fields of a header line as a map; the key ends at the first colon."""
    parts = F.split(line, "\t")
    fields = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, "^[^:]*:", "").alias("v"))))


def header(lines: DataFrame, kind: str) -> DataFrame:
    """(path, tags map<string,string>) of the header lines @SQ, @RG, @PG or @HD."""
    return lines.filter(F.startswith("value", F.lit(f"@{kind}\t"))).select("path", _tags(F.col("value")).alias("tags"))


def header_targets(lines: DataFrame) -> DataFrame:
    return header(lines, "SQ").select("path", F.try_element_at("tags", F.lit("SN")).alias("name"), F.try_element_at("tags", F.lit("LN")).cast("long").alias("length"))


def duplicate_targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("path", "name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def read_groups(lines: DataFrame) -> DataFrame:
    """(path, rg, sample): the sample is the file's name where @RG has none."""
    return header(lines, "RG").select("path", F.try_element_at("tags", F.lit("ID")).alias("rg"), F.coalesce(F.try_element_at("tags", F.lit("SM")), stem("path", "sam")).alias("sample"))


def programs(lines: DataFrame) -> DataFrame:
    return header(lines, "PG").select("path", *(F.try_element_at("tags", F.lit(k)).alias(v) for k, v in (("ID", "id"), ("PN", "name"), ("VN", "version"), ("CL", "command"))))


def sort_order(lines: DataFrame) -> DataFrame:
    return header(lines, "HD").select("path", F.try_element_at("tags", F.lit("SO")).alias("sort_order"))


def sample_catalogue(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, sample, n_samples, warning): a file becomes a row for each of its samples; without read groups its name is the sample."""
    s = files.join(groups.select("path", "sample").distinct(), "path", "left").withColumn("sample", F.coalesce("sample", stem("path", "sam")))
    s = s.withColumn("n_samples", F.count(F.lit(1)).over(Window.partitionBy("path")))
    return s.withColumn("warning", F.when(F.count(F.lit(1)).over(Window.partitionBy("sample")) > 1, F.lit("sample in several files")))


def preflight_limits(files: DataFrame, max_files: int = 1, max_bytes: int = 5 << 30) -> DataFrame:
    """(rule, value) of limits that the inputs (path, bytes) exceed."""
    a = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    rules = F.array(F.when(F.col("n") > max_files, F.struct(F.lit("files").alias("rule"), F.col("n").alias("value"))), F.when(F.col("b") > max_bytes, F.struct(F.lit("bytes").alias("rule"), F.col("b").alias("value"))))
    return a.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def contig_list(spark: SparkSession, path: str) -> DataFrame:
    """(list, ord, name, length, offset) of tab-separated contig lists without a header; check with ``offset_violations``.

    ord is the line's place in its file: partition and row of a scan whose splits follow the file.
    """
    t = spark.read.csv(path, sep="\t", schema="name string, length bigint, offset bigint")
    t = t.select(F.col("_metadata.file_path").alias("list"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "name", "length", "offset")
    return t.withColumn("ord", F.row_number().over(Window.partitionBy("list").orderBy("_at", "_id"))).select("list", "ord", "name", "length", "offset")


def totals(contigs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(list, rule): lists whose contig number or total length differs from their manifest (list, num_contigs, total_bases)."""
    a = contigs.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).join(manifest, "list", "full")
    bad = F.array_compact(F.array(F.when(~F.col("n").eqNullSafe(F.col("num_contigs")), "num_contigs"), F.when(~F.col("b").eqNullSafe(F.col("total_bases")), "total_bases")))
    return a.select("list", F.explode(bad).alias("rule"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a scan with ``_seg``, the headers before in their split, ``_name``, the last of those, and ``_at``, the bases since."""
    last, seg, name, at = None, 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        f, p, n = b.column("_f"), b.column("_p").to_numpy(), b.column("_n")
        i, size, head = np.arange(b.num_rows), b.column("_size").to_numpy(), n.is_valid().to_numpy(zero_copy_only=False)
        new = np.concatenate([[(f[0].as_py(), p[0]) != last], pc.not_equal(f.slice(1), f.slice(0, len(f) - 1)).to_numpy(zero_copy_only=False) | (p[1:] != p[:-1])])
        begun = np.maximum.accumulate(np.where(new, i, -1))  # -1: what the batch before left goes on
        heads = np.cumsum(head)
        segs = heads - np.where(begun >= 0, (heads - head)[begun], -seg)
        named = np.maximum.accumulate(np.where(head, i, -1))
        names = pa.concat_arrays([pa.array([name], n.type), n]).take(pa.array(named + 1, mask=(named < begun)))
        before, reset = np.cumsum(size) - size, np.maximum(begun, named)
        ats = before - np.where(reset >= 0, before[reset], -at)
        last, seg, name, at = (f[-1].as_py(), p[-1]), int(segs[-1]), names[-1].as_py(), int(ats[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([f, b.column("_p"), b.column("bases"), b.column("_size"), pa.array(segs, pa.int64()), names, pa.array(ats, pa.int64())], names=["_f", "_p", "bases", "_size", "_seg", "_name", "_at"])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr_id, offset, bases) of sequence lines.

    Offsets need each file's order: splits are told by file and first byte, and a task reads a split's lines in order, so running values inside
    a split need neither a sort nor a shuffle of lines. What a split hands on is one row, its last header and the bases behind it; these rows
    (one for each 128 MB) are broadcast to the lines, which are written once.
    """
    head, bases = F.startswith("value", F.lit(">")), F.trim("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_p"), F.when(head, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("_n"), F.when(~head, bases).alias("bases"),
        F.when(head, 0).otherwise(F.length(bases)).cast("long").alias("_size"),
    )
    run = saved(lines.mapInArrow(_running, "_f string, _p long, bases string, _size long, _seg long, _name string, _at long"))
    split, end = ["_f", "_p"], F.col("_at") + F.col("_size")
    # each split's last header and the bases after it carry on into the file's next splits
    ends = run.groupBy(*split).agg(F.max_by(F.struct(F.col("_name").alias("n"), end.alias("b")), F.struct("_seg", end)).alias("e"), F.max("_seg").alias("_s"))
    w = Window.partitionBy("_f").orderBy("_p")
    ends = ends.withColumn("_g", F.sum(F.when(F.col("_s") > 0, 1).otherwise(0)).over(w))
    ends = ends.withColumn("_carry_n", F.last(F.col("e.n"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    tail = Window.partitionBy("_f", "_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_run", F.sum(F.col("e.b")).over(tail)).withColumn("_carry_b", F.coalesce(F.lag("_run").over(w), F.lit(0)))
    j = run.filter(F.col("_size") > 0).join(F.broadcast(ends.select(*split, "_carry_n", "_carry_b")), split)
    offset = F.col("_at") + F.when(F.col("_seg") == 0, F.col("_carry_b")).otherwise(F.lit(0))
    return j.select(F.coalesce("_name", "_carry_n").alias("chr_id"), offset.cast("long").alias("offset"), "bases")


def checked_alignments(reads: DataFrame, targets: DataFrame, headers: DataFrame) -> DataFrame:
    """``reads`` on the contigs of ``targets`` (id, length); a target that the header (name, length) lacks or has in another length is an error."""
    t = targets.select(F.col("id").alias("rname"), F.col("length").alias("_want")).join(headers.select(F.col("name").alias("rname"), F.col("length").alias("_l")), "rname", "left")
    bad = F.raise_error(F.concat(F.lit("contig length differs from the header: "), "rname")).cast("boolean")
    ok = F.when(F.col("_l").eqNullSafe(F.col("_want")), True).otherwise(bad)
    return reads.join(t.filter(ok).select("rname"), "rname", "left_semi")


def input_rows(inputs: DataFrame, provenance: DataFrame) -> DataFrame:
    """``inputs`` (path, …) with what their run's ``provenance`` (path, …) says besides; columns that inputs have stay theirs."""
    more = [c for c in provenance.columns if c not in inputs.columns]
    return inputs.join(provenance.select("path", *more), "path", "left")


def result_table(spark: SparkSession, folder: str, table: str, resolution: int | None = None) -> DataFrame:
    """A saved result's table; a resolution prunes partitions."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{table}")
    return df if resolution is None else df.filter(F.col("resolution") == resolution)
