"""Matching of file headers with registered contigs, and choice of species pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def header_match(header: DataFrame, registry: DataFrame) -> DataFrame:
    """(assembly, n_targets, n_matched, n_missing, n_mismatch, score, exact) of each registered assembly.

    ``header``: name, length; ``registry``: assembly, id, length.
    """
    h = header.select(F.col("name").alias("id"), F.col("length").alias("_l"))
    j = registry.join(h, "id", "left")
    a = j.groupBy("assembly").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("_l") == F.col("length")).alias("n_matched"), F.count_if(F.col("_l").isNull()).alias("n_missing"), F.count_if(F.col("_l") != F.col("length")).alias("n_mismatch"))
    return a.withColumns({"score": F.col("n_matched") / F.col("n_targets"), "exact": F.col("n_matched") == F.col("n_targets")})


def candidate_order():
    return [F.desc("score"), F.desc("n_targets"), F.col("assembly")]


def best_candidate(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*candidate_order()).limit(1)


def most_specific(matches: DataFrame) -> DataFrame:
    """The exact match with most targets; two of them are an error; without one, the closest, as ``found`` = false."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact")), F.desc(F.when(F.col("exact"), F.col("n_targets")).otherwise(0)), *candidate_order())
    top = Window.partitionBy(F.lit(0))
    m = matches.withColumn("_most", F.max(F.when(F.col("exact"), F.col("n_targets"))).over(top)).withColumn("_ties", F.count_if(F.col("exact") & (F.col("n_targets") == F.col("_most"))).over(top))
    m = m.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    name = F.when(F.col("_ties") > 1, F.raise_error(F.lit("several assemblies match exactly"))).otherwise(F.col("assembly"))
    return m.select(name.alias("assembly"), "n_targets", "score", F.col("exact").alias("found"))


def agree(matches_by_file: DataFrame) -> DataFrame:
    """(n_files, n_assemblies, agreed) over each file's assembly."""
    return matches_by_file.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("assembly").alias("n_assemblies")).withColumn("agreed", F.col("n_assemblies") == 1)


def species_pairs(header: DataFrame, contigs: DataFrame) -> DataFrame:
    """(recipient, donor, n_targets, n_matched, score, exact) of ordered pairs of species with any contig in the header.

    A pair's targets are both species' contigs, so its counts are sums of each species' counts; species are a short table.
    """
    h = header.select(F.col("name").alias("id"), F.col("length").alias("_l"))
    s = contigs.join(h, "id", "left").groupBy("species").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("_l") == F.col("length")).alias("m"), F.count("_l").alias("any")).filter(F.col("any") > 0)
    r = s.select(F.col("species").alias("recipient"), F.col("t").alias("rt"), F.col("m").alias("rm"))
    d = s.select(F.col("species").alias("donor"), F.col("t").alias("dt"), F.col("m").alias("dm"))
    p = r.join(d, F.col("recipient") != F.col("donor"))
    return p.select("recipient", "donor", (F.col("rt") + F.col("dt")).alias("n_targets"), (F.col("rm") + F.col("dm")).alias("n_matched")).withColumns({"score": F.col("n_matched") / F.col("n_targets"), "exact": F.col("n_matched") == F.col("n_targets")})


def choose_pair(pairs: DataFrame, donor: str | None = None, recipient: str | None = None) -> DataFrame:
    """One exact pair: that of the current donor, else of the current recipient, else the largest."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce(F.col("donor") == donor, F.lit(False)) if donor else F.lit(False)), F.desc(F.col("recipient") == recipient if recipient else F.lit(False)), F.desc("n_targets"), "recipient", "donor")
    return pairs.filter("exact").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve_key(rows: DataFrame, table: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """``rows`` (row_id, …) with ``value`` from ``table`` by the first level of keys that matches; ties give several rows."""
    found = None
    for k, keys in enumerate(levels):
        hit = rows.join(table.select(*keys, value).distinct(), keys).select("row_id", F.col(value).alias("_v"), F.lit(k).alias("_k"))
        found = hit if found is None else found.unionByName(hit)
    best = found.withColumn("_b", F.min("_k").over(Window.partitionBy("row_id"))).filter("_k = _b").select("row_id", F.col("_v").alias(value), F.col("_k").alias("level")).distinct()
    return rows.join(best, "row_id", "left")


def resolve_pair(contigs: DataFrame, recipient: str, donor: str, min_length: int = 0, max_length: int = 1 << 62) -> DataFrame:
    """Targets of a species pair; equal sides, a shared contig or a length out of range are errors."""
    from covertile.operators.tiling import targets

    if recipient == donor:
        raise ValueError("donor and recipient are the same species")
    t = targets(contigs, recipient, donor).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("contig on both sides: "), "id"))).when(~F.col("length").between(min_length, max_length), F.raise_error(F.concat(F.lit("contig length out of range: "), "id"))).otherwise(F.col("id"))
    return t.withColumn("id", checked).drop("_n")
