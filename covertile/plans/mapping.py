"""The driver's tables as samples, groups, roles and positions.

sample = customer's segment, group = supplier's region, role = donor for returned lines, component = line status, position = 1,000 x days
since 1995-01-01 of the shipping date + order number mod 1,000, length = quantity, mapping quality = 1,000 x discount. The tables are
even noise, so ``EVENTS`` says where this mapping reads lines in another way, for the operators to find something: in its stretch of windows
``swap`` makes all lines of status F donors, ``more`` makes donor lines of status F six times as long, ``less`` makes recipient lines one base
long, ``both`` does the latter two. Every line counts, none is left out. The SQL of the queries says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covertile.operators import calibrate, intervals, metrics, reads, scoring, segment, tiling
from covertile.params import Params
from covertile.plans.tables import saved

LENGTH, N, READ = 2_600_000, 50, 25.37
#: Bases of a group in calls, so that widths meet the length bins.
GROUP_BP = 260_000_000
PARAMS = Params(min_mb=0.0, floors_multi=(0.9, 0.7, 0.5, 0.25, 0.25))
#: Scores over it make a call.
LIMIT = 0.3
#: (sample or None for all, group, first window, last window, kind)
EVENTS = [
    (None, "EUROPE", 45, 47, "more"),
    ("AUTOMOBILE", "AFRICA", 5, 14, "swap"), ("AUTOMOBILE", "ASIA", 20, 29, "more"), ("AUTOMOBILE", "EUROPE", 3, 8, "less"),
    ("BUILDING", "AMERICA", 0, 12, "more"), ("BUILDING", "EUROPE", 30, 37, "less"), ("BUILDING", "MIDDLE EAST", 20, 25, "both"),
    ("FURNITURE", "MIDDLE EAST", 10, 19, "swap"), ("FURNITURE", "AFRICA", 40, 47, "more"),
    ("HOUSEHOLD", "ASIA", 8, 15, "both"), ("HOUSEHOLD", "EUROPE", 22, 27, "swap"), ("HOUSEHOLD", "AMERICA", 44, 49, "swap"),
    ("MACHINERY", "AMERICA", 33, 42, "less"), ("MACHINERY", "AFRICA", 18, 29, "more"),
]


def event_sql() -> str:
    """The kind of a line as a CASE over sample, grp and start."""
    whens = [f"when {f'sample = {chr(39)}{s}{chr(39)} and ' if s else ''}grp = '{g}' and start >= {a * LENGTH // N} and start < {(b + 1) * LENGTH // N} then '{k}'" for s, g, a, b, k in EVENTS]
    return "case " + " ".join(whens) + " else 'none' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_table(spark: SparkSession) -> DataFrame:
    """(grp, w, who, kind): the windows of the events, a few hundred rows; who is NULL for all samples."""
    rows = [(g, w, who, kind) for who, g, a, b, kind in EVENTS for w in range(a, b + 1)]
    values = ", ".join(f"('{g}', {w}, {chr(39) + who + chr(39) if who else 'cast(null as string)'}, '{kind}')" for g, w, who, kind in rows)
    return spark.sql(f"select * from values {values} as t(grp, w, who, kind)")


def intervals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each order line. Suppliers' places are a small table of known size before the lines meet it; events are joined by group and window."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sample"))
    place = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n"))
    place = place.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r")), "n").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("grp")), "r")
    place = saved(place.select("l_suppkey", "grp"))
    j = li.join(place, "l_suppkey").join(o.join(c, "o_custkey"), "l_orderkey")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
    j = j.withColumn("start", day * 1000 + F.col("l_orderkey") % 1000).withColumn("w", F.expr(f"start * {N} div {LENGTH}"))
    e = event_table(spark)
    j = j.join(F.broadcast(e), (j["grp"] == e["grp"]) & (j["w"] == e["w"]) & (e["who"].isNull() | (e["who"] == j["sample"])), "left").drop(e["grp"], e["w"]).withColumn("kind", F.coalesce("kind", F.lit("none")))
    f = F.col("l_linestatus") == "F"
    j = j.withColumn("role", F.when((F.col("l_returnflag") == "R") | ((F.col("kind") == "swap") & f), "donor").otherwise("recipient"))
    size = F.when(F.col("kind").isin("less", "both") & (F.col("role") == "recipient"), 1).when(F.col("kind").isin("more", "both") & f & (F.col("role") == "donor"), F.col("l_quantity").cast("long") * 6).otherwise(F.col("l_quantity").cast("long"))
    name = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    read = F.concat_ws("-", *(F.col(c).cast("string") for c in name))
    # equal for equal names, which leave out a NULL
    key = F.when(F.col("l_linenumber").isNotNull() & F.col("l_partkey").isNotNull(), F.xxhash64(*name)).otherwise(F.xxhash64(read))
    return j.select(
        read.alias("read"), key.alias("read_key"), "sample", "grp", "role", F.col("l_linestatus").alias("component"), F.concat_ws("_", "grp", "role", "l_linestatus").alias("chr_id"),
        "start", (F.col("start") + size).alias("stop"), F.round(F.col("l_discount") * 1000).cast("int").alias("mapq"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),  # whole per cent, so that sums are exact
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each region, role and line status; no scan of the lines."""
    every = lambda *x: F.explode(F.array(*(F.lit(v) for v in x)))
    c = table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), every("donor", "recipient").alias("role")).withColumn("component", every("F", "O"))
    return c.select(F.concat_ws("_", "grp", "role", "component").alias("chr_id"), "grp", "role", "component", F.lit(LENGTH).cast("long").alias("length"), F.lit(2.0).alias("copy_number"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.in_windows(intervals_of(spark, sf_dir), contigs(spark, sf_dir), N)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of windows, with the tax of the lines that begin in them; one scan of the lines."""
    begins: Column = F.col("clip_start") == F.col("start")
    return reads.count_windows(pieces(spark, sf_dir), sums={"tax": F.when(begins, F.col("tax")), "begun": begins.cast("int")}, read="read_key")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window metrics as a table; counts are written once, as tax and grid both read them."""
    counts = saved(window_counts(spark, sf_dir))
    tax = counts.groupBy("chr_id", "iid").agg((F.sum("tax") / F.sum("begun") / 100).alias("gc"))
    w = tiling.tile(contigs(spark, sf_dir), N)
    grid = reads.on_grid(counts.drop("tax", "begun"), w.select("chr_id", "iid"), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sample")))
    return saved(metrics.window_metrics(grid, w.drop("length"), tax, READ, need_gc=False))


def score_rows(metric: DataFrame, params: Params = PARAMS) -> DataFrame:
    return scoring.score_pairs(metric, params)


def residual_rows(metric: DataFrame) -> DataFrame:
    """Scores as a table, with spreads and residuals: log depths less their median in the sample's group."""
    w = Window.partitionBy("sample", "grp")
    keys = ["sample", "grp", "iid"]
    s = score_rows(metric).join(scoring.spread(metric, "donor", PARAMS), keys, "left").join(scoring.spread(metric, "recipient", PARAMS), keys, "left")
    return saved(s.withColumns({name: F.col(c) - F.median(c).over(w) for c, name in (("log_donor", "donor_residual"), ("log_recipient", "recipient_residual"), ("log_total", "total_residual"))}))


def run_segments(scores: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Stretches of windows whose score exceeds ``limit``, as segments with their means."""
    r = intervals.runs(scores, ["sample", "grp"], "iid", F.col("score") > limit)
    segs = r.select("sample", "grp", F.col("run_start").alias("start_iid"), F.col("run_stop").alias("end_iid"), F.col("run_width").alias("n_windows"))
    return segment.evidence(segs, scores, ["score", *segment.EVIDENCE]).withColumnRenamed("score", "score_mean")


def group_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), F.lit(GROUP_BP).cast("long").alias("length"))


def call_rows(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """Segments with coordinates, thresholds (floors of many samples) and pass."""
    segs = run_segments(residual_rows(metric_rows(spark, sf_dir)) if scores is None else scores)
    calls = segment.coordinates(segs, group_lengths(spark, sf_dir), N)
    floors = calibrate.bin_table(spark, PARAMS, "multi").withColumn("threshold", F.col("floor"))
    c = calibrate.passing(calls, floors, PARAMS, "multi")
    return c.withColumn("call_id", F.concat_ws("_", "sample", "grp", F.col("start_iid").cast("string"), F.col("end_iid").cast("string")))
