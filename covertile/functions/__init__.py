"""Column expressions that the operators share. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL; the library uses NULL only."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def finite_all(df: DataFrame) -> DataFrame:
    """``finite`` on every floating-point column, at ingest."""
    return df.select(*(finite(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields))


def clamp(c: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL unless b > 0."""
    return F.when(col(b) > 0, col(a) / col(b))


def first_number(name: str | Column) -> Column:
    """The first number in a name, without leading zeros; NULL if there is none."""
    digits = F.regexp_extract(col(name), "([0-9]+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=[0-9])", ""))


def natural_key(c: str | Column, width: int = 20) -> Column:
    """A sort key under which digit runs compare as numbers and letters without case."""
    c = col(c)
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda t: F.when(F.rlike(t, F.lit(r"^\d+$")), F.lpad(F.regexp_replace(t, "^0+(?=[0-9])", ""), width, "0")).otherwise(F.lower(t))), "\u0001")


def natural_order(c: str) -> list[Column]:
    return [natural_key(c).asc_nulls_last(), F.lower(c).asc_nulls_last(), F.col(c).asc_nulls_last()]


def group_order(c: str) -> list[Column]:
    """Numbers first and as numbers, then text."""
    return [F.expr(f"try_cast(`{c}` as int)").asc_nulls_last(), F.col(c)]


def stem(path: str | Column, suffix: str = "bam") -> Column:
    """The file's name without its suffix, whatever the case."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), rf"(?i)\.{suffix}$", "")


def safe_name(c: str | Column) -> Column:
    """A folder name: other characters become ``-``, dots and dashes at the ends go."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")


def whole_div(a: Column, b: Column) -> Column:
    """Division of whole numbers without a remainder, exact for all longs (not negative)."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def window_of(pos: Column, length: Column, n: Column) -> Column:
    """The window that holds base ``pos`` when ``length`` bases are tiled by n windows with borders at floor(i L / n)."""
    return whole_div((pos + 1) * n - 1, length)


def cigar_blocks(cigar: str | Column, pos: str | Column, count_deletions: bool = False) -> Column:
    """array<struct<s,e>> of the reference bases that an alignment covers (M, =, X, and D if asked), 0-based half-open."""
    lengths = F.regexp_extract_all(col(cigar), F.lit(r"(\d+)([MIDNSHP=X])"), 1)
    kinds = F.regexp_extract_all(col(cigar), F.lit(r"(\d+)([MIDNSHP=X])"), 2)
    ops = F.zip_with(lengths, kinds, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    covers = ["M", "=", "X"] + (["D"] if count_deletions else [])
    start = F.struct(col(pos).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        moves = op["k"].isin("M", "=", "X", "D", "N")
        end = acc["at"] + op["n"]
        return F.struct(
            F.when(moves, end).otherwise(acc["at"]).alias("at"),
            F.when(op["k"].isin(*covers), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda a: a["out"])


def aligned_bases(cigar: str | Column) -> Column:
    """Bases of the query that align (M, =, X)."""
    return F.aggregate(F.transform(F.regexp_extract_all(col(cigar), F.lit(r"(\d+)[M=X]"), 1), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def reference_end(cigar: str | Column, pos: str | Column) -> Column:
    """The position after the alignment's last reference base."""
    return col(pos) + F.aggregate(F.transform(F.regexp_extract_all(col(cigar), F.lit(r"(\d+)[MDN=X]"), 1), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def digest(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def bp_text(c: str | Column) -> Column:
    """12,345 bp as ``12.3 kb``."""
    c = col(c)
    return F.when(c.isNull(), None).when(c >= 1e6, F.format_string("%.1f Mb", c / 1e6)).when(c >= 1e3, F.format_string("%.1f kb", c / 1e3)).otherwise(F.format_string("%.0f bp", c.cast("double")))


def signed_text(c: str | Column, digits: int = 2) -> Column:
    """A number with its sign, ``+1.50``; NA if there is none."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "NA").otherwise(F.concat(F.when(c > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", c)))


def percent_text(c: str | Column) -> Column:
    """A fraction as whole per cent, ``12%``; NA if there is none."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "NA").otherwise(F.concat(F.format_string("%.0f", F.rint(100 * c)), F.lit("%")))


def span_text(start: str | Column, stop: str | Column) -> Column:
    """Two positions as a span; ``from`` or ``to`` if one is missing, empty if both are. Negative positions are NA."""
    a, b = col(start), col(stop)
    words = lambda c: F.when(c < 0, "NA").otherwise(bp_text(c))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(words(a), F.lit(" – "), words(b))).when(a.isNotNull(), F.concat(F.lit("from "), words(a))).when(b.isNotNull(), F.concat(F.lit("to "), words(b))).otherwise("")


def iso_text(c: str | Column) -> Column:
    """A timestamp as ISO text with its offset, ``2024-05-01T12:30:00+0000``, in the session's time zone."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ssxx")


def seconds_between(start: str | Column, stop: str | Column) -> Column:
    """Duration in seconds, fractions included."""
    return (F.unix_micros(col(stop).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / 1e6
