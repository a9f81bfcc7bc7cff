"""Declared schemas, and what brings a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(ddl: str) -> T.StructType:
    """Columns ``name type`` as a schema; no session is needed."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (part.split() for part in ddl.split(","))])


ALIGNMENTS = struct("qname string, flag int, rname string, pos bigint, mapq int, cigar string, rg string")
CONTIGS = struct("species string, id string, name string, component string, grp string, copy_number double, length bigint")
WINDOWS = struct("chr_id string, start bigint, stop bigint, iid bigint, role string, chr_name string, component string, grp string, copy_number double")
METRICS = struct(
    "sample string, chr_id string, chr_name string, grp string, role string, component string, copy_number double, iid bigint, start bigint, stop bigint, length bigint, gc double,"
    " count bigint, mapq_high bigint, covered bigint, read_length double, breadth double, mapq_high_fraction double, lambda_breadth double, lambda_count double"
)
SCORES = struct("sample string, grp string, iid bigint, start bigint, stop bigint, score double, score_raw double, donor_mean double, recipient_mean double, donor_component string, donor_source string, n_donor bigint, n_recipient bigint, supported_donors bigint, donor_spread double, recipient_spread double, log_donor double, log_recipient double, log_total double")
MASKS = struct("grp string, iid bigint, f double, posterior double, mask boolean")
CALIBRATION = struct("mode string, bin int, length_bin string, n_control bigint, q99 double, threshold double, fdr double")
SEGMENTS = struct("sample string, grp string, start_iid bigint, end_iid bigint, n_windows bigint, score_mean double")
CALLS = struct(
    "call_id string, sample string, grp string, mode string, start_iid bigint, end_iid bigint, n_windows bigint, start_bp bigint, end_bp bigint, width_bp bigint, score_mean double, donor_residual double, recipient_residual double, total_residual double,"
    " donor_spread double, recipient_spread double, supported_donors double, mapq_high_fraction double, length_bin string, threshold double, pass boolean, class string, class_group string, class_confidence string, class_status string, copy_state string,"
    " evidence string, compound boolean, donor_component string, component_status string, mappability_status string, recipient_assignment string, recipient_chr string, recipient_group string, recipient_start_iid bigint, recipient_end_iid bigint,"
    " assignment_score double, assignment_margin double, assignment_weight double, runner_up string"
)
#: Result orders of calls, metrics and scores; written where a table leaves Spark.
ORDERS = {"calls": ["sample", "grp", "start_iid"], "metrics": ["sample", "chr_id", "iid"], "scores": ["sample", "grp", "iid"]}
#: What a finished analysis holds (contract): table -> columns that must be there.
RESULT = {
    "windows": {"chr_id", "start", "stop", "iid"}, "metrics": set(METRICS.names), "scores": {"sample", "grp", "iid", "score"}, "masks": {"grp", "iid", "mask"},
    "calibration": {"mode", "bin", "threshold"}, "calls": {"sample", "grp", "start_iid", "end_iid", "class", "pass"},
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the schema's columns: cast, in order, missing ones as NULL or their default."""
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in schema.fields:
        if f.name.lower() in have:
            c = F.col(f"`{have[f.name.lower()]}`").cast(f.dataType)
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def ordered(df: DataFrame, table: str, contigs: DataFrame | None = None) -> DataFrame:
    """``df`` in the result order of ``table``; metrics by the place (ord) of their contig where ``contigs`` (chr_id, ord) says it."""
    if table == "metrics" and contigs is not None:
        return df.join(F.broadcast(contigs.select("chr_id", F.col("ord").alias("_ord"))), "chr_id", "left").orderBy("sample", F.col("_ord").asc_nulls_last(), "chr_id", "iid").drop("_ord")
    return df.orderBy(*ORDERS[table])


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def missing(tables: dict[str, DataFrame], contract: dict[str, set[str]] = RESULT) -> list[tuple[str, str]]:
    """(table, column) of the contract that ``tables`` lack; an absent table lacks all its columns."""
    return sorted((t, c) for t, need in contract.items() for c in need - set(tables[t].columns if t in tables else []))


def validate(tables: dict[str, DataFrame], contract: dict[str, set[str]] = RESULT) -> None:
    lack = missing(tables, contract)
    if lack:
        raise ValueError("missing: " + ", ".join(f"{t}.{c}" for t, c in lack))
