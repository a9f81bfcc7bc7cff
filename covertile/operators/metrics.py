"""Window metrics, base composition and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import clamp, ratio, whole_div, window_of


def window_metrics(counts: DataFrame, windows: DataFrame, gc: DataFrame | None = None, read_length: float | DataFrame = 100.0, need_gc: bool = True) -> DataFrame:
    """Counts (sample, chr_id, iid, count, mapq_high, covered) with their window's columns and derived measures.

    breadth = covered / length in 0..1; lambda_breadth = -ln(1 - breadth); lambda_count = count x read length / length. A window
    that ``gc`` doesn't have is an error, unless ``need_gc`` is off. ``read_length`` may be a table (sample, read_length).
    """
    w = windows.withColumn("length", F.col("stop") - F.col("start"))
    j = counts.join(w.select("chr_id", "iid", *[c for c in w.columns if c not in counts.columns and c not in ("chr_id", "iid")]), ["chr_id", "iid"])
    if gc is None:
        j = j.withColumn("gc", F.lit(None).cast("double"))
    else:
        j = j.join(gc.select("chr_id", "iid", "gc", F.lit(True).alias("_gc")), ["chr_id", "iid"], "left")
        if need_gc:
            bad = F.raise_error(F.concat_ws(" ", F.lit("no base composition of window"), "chr_id", F.col("iid").cast("string"))).cast("double")
            j = j.withColumn("gc", F.when(F.col("_gc").isNull(), bad).otherwise(F.col("gc")))
        j = j.drop("_gc")
    if isinstance(read_length, DataFrame):
        j = j.join(read_length.select("sample", F.col("read_length").cast("double")), "sample", "left")
    else:
        j = j.withColumn("read_length", F.lit(float(read_length)))
    breadth = clamp(F.col("covered") / F.col("length"), 0.0, 1.0)
    return j.withColumns({
        "breadth": breadth, "mapq_high_fraction": ratio("mapq_high", "count"),
        "lambda_breadth": -F.log(F.greatest(F.lit(1.0) - breadth, F.lit(1e-12))), "lambda_count": F.col("count") * F.coalesce("read_length", F.lit(0.0)) / F.col("length"),
    })


def depth(metric: str, eps: float = 1e-4) -> Column:
    """The depth scale: breadth, count, or the geometric mean of both."""
    b, c = F.col("lambda_breadth"), F.col("lambda_count")
    return {"breadth": b, "count": c, "combined": F.sqrt((b + eps) * (c + eps))}[metric]


def base_composition(chunks: DataFrame, contigs: DataFrame, n: int, remove_ambiguous: bool = False) -> DataFrame:
    """(chr_id, iid, gc): the share of G and C in each window, from sequence chunks (chr_id, offset, bases).

    A chunk is cut at window borders; U counts as T, ambiguity codes never as G or C; the quotient is taken in single precision.
    """
    length, m = F.col("length"), F.lit(n).cast("long")
    c = chunks.join(contigs.select("chr_id", "length"), "chr_id").withColumn("stop", F.col("offset") + F.length("bases")).filter("stop > offset")
    c = c.withColumn("iid", F.explode(F.sequence(window_of(F.col("offset"), length, m), window_of(F.col("stop") - 1, length, m))))
    lo = F.greatest("offset", whole_div(F.col("iid") * length, m))
    hi = F.least("stop", whole_div((F.col("iid") + 1) * length, m))
    part = F.upper(F.substring("bases", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")))
    c = c.withColumns({"_gc": F.length(F.regexp_replace(part, "[^GC]", "")), "_n": F.length(F.regexp_replace(part, "[^ACGTU]", "")) if remove_ambiguous else (hi - lo)})
    s = c.groupBy("chr_id", "iid").agg(F.sum("_gc").alias("g"), F.sum("_n").alias("t"))
    return s.select("chr_id", "iid", F.when(F.col("t") > 0, (F.col("g").cast("float") / F.col("t").cast("float")).cast("float").cast("double")).alias("gc"))


def violations(metrics: DataFrame, n: int) -> DataFrame:
    """(rule, sample, chr_id, iid) of rows that break a rule of window metrics."""
    rules = {
        "name": F.col("chr_id").isNull() | F.col("sample").isNull(), "window": ~F.col("iid").between(0, n - 1), "coordinates": (F.col("start") < 0) | (F.col("stop") <= F.col("start")),
        "count": (F.col("count") < 0) | (F.col("mapq_high") > F.col("count")), "covered": (F.col("covered") < 0) | (F.col("covered") > F.col("length")), "gc": ~F.col("gc").between(0.0, 1.0),
    }
    found = F.filter(F.array(*(F.when(bad, F.lit(k)) for k, bad in rules.items())), lambda r: r.isNotNull())
    return metrics.withColumn("rule", F.explode(found)).select("rule", "sample", "chr_id", "iid")


def coverage_warnings(metrics: DataFrame, near_zero: float = 1.0) -> DataFrame:
    """(sample, role, reads, windows, warning): no reads on a side, or fewer than ``near_zero`` per window."""
    a = metrics.groupBy("sample", "role").agg(F.sum("count").alias("reads"), F.count(F.lit(1)).alias("windows"))
    a = a.withColumn("warning", F.when(F.col("reads") <= 0, "no reads").when(F.col("reads") < near_zero * F.col("windows"), "few reads"))
    return a.filter("warning is not null")


def run_coverage(metrics: DataFrame) -> DataFrame:
    """(samples, empty_samples, first_empty): one row; a sample is empty if no window of it has a read, and the first is by name."""
    by = metrics.groupBy("sample").agg((F.coalesce(F.sum("count"), F.lit(0)) <= 0).alias("_e"))
    return by.agg(F.count(F.lit(1)).alias("samples"), F.count_if("_e").alias("empty_samples"), F.min(F.when(F.col("_e"), F.col("sample"))).alias("first_empty"))


def deleted_contigs(metrics: DataFrame, breadth: float = 0.001, relative: float = 0.1) -> DataFrame:
    """(sample, chr_id, mean_breadth): contigs with next to no coverage, absolutely and against the sample's median contig."""
    m = metrics.groupBy("sample", "chr_id").agg(F.avg("breadth").alias("mean_breadth"))
    m = m.withColumn("typical", F.median("mean_breadth").over(Window.partitionBy("sample")))
    return m.filter((F.col("mean_breadth") < breadth) & (F.col("mean_breadth") < relative * F.col("typical"))).drop("typical")
