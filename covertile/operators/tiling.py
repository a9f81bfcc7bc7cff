"""Exact tiling of contigs into windows, and checks of contigs and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import first_number, whole_div


def targets(contigs: DataFrame, recipient: str, donor: str) -> DataFrame:
    """Recipient contigs, then donor contigs, with role and order; group defaults to the first number in the name."""
    role = F.when(F.col("species") == recipient, "recipient").when(F.col("species") == donor, "donor")
    t = contigs.withColumn("role", role).filter(F.col("role").isNotNull())
    t = t.withColumn("grp", F.coalesce("grp", first_number("name"))).withColumn("copy_number", F.coalesce("copy_number", F.lit(2.0)))
    order = F.row_number().over(Window.partitionBy("role").orderBy("id"))
    return t.withColumn("ord", F.when(F.col("role") == "recipient", order).otherwise(order + F.lit(1 << 30)))


def tile(contigs: DataFrame, n: int, length: str = "length") -> DataFrame:
    """``n`` windows of each contig: start = floor(i L / n), stop = floor((i + 1) L / n). Contigs shorter than n get none."""
    size = F.col(length).cast("long")
    out = contigs.filter(size >= n).withColumn("iid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out.withColumns({"start": whole_div(F.col("iid") * size, F.lit(n)), "stop": whole_div((F.col("iid") + 1) * size, F.lit(n))})


def too_short(contigs: DataFrame, resolutions: list[int]) -> DataFrame:
    """(resolution, n_contigs, n_windows, n_short): the grid at each resolution and the contigs too short for it."""
    r = contigs.withColumn("resolution", F.explode(F.array(*(F.lit(x) for x in resolutions))))
    return r.groupBy("resolution").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.when(F.col("length") >= F.col("resolution"), F.col("resolution")).otherwise(0)).alias("n_windows"), F.count_if(F.col("length") < F.col("resolution")).alias("n_short"))


def gaps(windows: DataFrame, key: str = "chr_id") -> DataFrame:
    """Windows that don't start where the one before stops."""
    before = F.lag("stop").over(Window.partitionBy(key).orderBy("iid"))
    return windows.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) != F.col("start"))


def offset_violations(contigs: DataFrame, by: str = "list") -> DataFrame:
    """(list, rule, key) of contig lists: names unique, lengths positive, offset = sum of the lengths before."""
    w = Window.partitionBy(by).orderBy("ord")
    c = contigs.withColumn("want", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(by, "name")))
    rules = F.array(_rule(F.col("times") > 1, "duplicate"), _rule(~(F.col("length") > 0), "length"), _rule(F.col("offset") != F.col("want"), "offset"))
    return c.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull()))).select(by, "rule", F.col("name").alias("key"))


def _rule(bad: Column, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))


def shared_between_lists(contigs: DataFrame, by: str = "list") -> DataFrame:
    """Names that stand in several lists."""
    return contigs.groupBy("name").agg(F.count_distinct(by).alias("lists")).filter("lists > 1")


def attach_lengths(contigs: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contigs with the reference's length, violations (id, reason)): not in the reference, or of another length."""
    ref = reference.select("id", F.col("length").alias("ref_length"))
    j = contigs.join(ref, "id", "left")
    bad = j.withColumn("reason", F.when(F.col("ref_length").isNull(), "missing").when(F.col("length") != F.col("ref_length"), "mismatch"))
    return j.withColumn("length", F.coalesce("length", "ref_length")).drop("ref_length"), bad.filter("reason is not null").select("id", "reason")


def pair_groups(contigs: DataFrame) -> DataFrame:
    """(grp, donor_id, recipient_id) by chromosome group; the first recipient of a group stands for it."""
    rep = F.row_number().over(Window.partitionBy("grp").orderBy("ord"))
    recipients = contigs.filter("role = 'recipient'").withColumn("n", rep).filter("n = 1").select("grp", F.col("id").alias("recipient_id"))
    return contigs.filter("role = 'donor'").select("grp", F.col("id").alias("donor_id")).join(recipients, "grp")


def unpaired(contigs: DataFrame) -> DataFrame:
    """(id, reason) of contigs whose group has no partner on the other side."""
    d, r = contigs.filter("role = 'donor'"), contigs.filter("role = 'recipient'")
    no_r = d.join(r, "grp", "left_anti").select("id", F.lit("no recipient in group").alias("reason"))
    return no_r.unionByName(r.join(d, "grp", "left_anti").select("id", F.lit("no donor in group").alias("reason")))


def inconsistent(contigs: DataFrame) -> DataFrame:
    """(species, component, rule): several copy numbers in a component, or several contigs in a component and group."""
    copies = contigs.groupBy("species", "component").agg(F.count_distinct("copy_number").alias("n")).filter("n > 1").select("species", "component", F.lit("copy_number").alias("rule"))
    more = contigs.groupBy("species", "component", "grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("species", "component", F.lit("group").alias("rule")).distinct()
    return copies.unionByName(more)


def catalogue(contigs: DataFrame) -> DataFrame:
    """Species with their numbers of contigs and groups, total length and components."""
    return contigs.groupBy("species").agg(F.count(F.lit(1)).alias("n_contigs"), F.count_distinct("grp").alias("n_groups"), F.sum("length").alias("total_length"), F.array_join(F.array_sort(F.collect_set("component")), ";").alias("components"))


def route(contigs: DataFrame, lists: DataFrame) -> DataFrame:
    """``contigs`` (id, …) with the composition source (list) that holds each; a contig in none or in several is an error."""
    at = lists.groupBy(F.col("name").alias("id")).agg(F.min("list").alias("source"), F.count_distinct("list").alias("_n"))
    j = contigs.join(at, "id", "left")
    bad = F.raise_error(F.concat(F.when(F.col("_n").isNull(), "no source of contig ").otherwise("several sources of contig "), "id"))
    return j.withColumn("source", F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("source")).otherwise(bad)).drop("_n")
