"""Sharding by fixed virtual slots. DataFrame functions only.

Records are hashed into ``SLOTS`` slots, bytes are summed by slot, and a versioned slot-to-shard map says where each slot
lives. The map is a table (version, vslot, bytes, shard); it is edited, never rebuilt, when shards are added or loads move.
``assign`` reads its newest version, edits it if the loads have moved, stores the next version and deals by that.
The law that holds is ``bytes``: the largest slots are placed first, each on the shard with the fewest bytes so far.

Cases: a null text has 16 bytes and crc32 0; records are hashed by doc_id and text, so null or repeated ids with different texts, and
equal texts under different ids, are dealt apart; rows that repeat in both share a slot and take different positions (one record that makes
up over a fortieth of all bytes can't be levelled, as a slot is not split); ties in a slot go by doc_id, crc32 and size; an empty
table gives an empty result; only doc_id and text are read, whatever other columns there are. Of a long text only its size and crc32 are kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covertile.llm.common import saved, scratch_dir

SLOTS = 4096
OVERHEAD = 16


def virtual_slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row; the text ends here."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.crc32(raw), F.octet_length(raw)).alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): SLOTS rows at most, whatever the input."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


ENTRY = "array<struct<vslot:int,bytes:bigint,rows:bigint,shard:int>>"


def _place(acc: Column, s: Column) -> Column:
    """The next slot goes to the shard with the fewest bytes so far."""
    at = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
    load = F.transform(acc["load"], lambda x, i: F.when(i == at, x + s["bytes"]).otherwise(x))
    entry = F.struct(s["vslot"].alias("vslot"), s["bytes"].alias("bytes"), s["rows"].alias("rows"), at.alias("shard"))
    return F.struct(load.alias("load"), F.concat(acc["out"], F.array(entry)).alias("out"))


def slot_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, bytes, rows, shard): slots by falling bytes, each to the shard that has least (ties: smaller shard).

    One aggregate over SLOTS rows at most; the loads so far are an array of ``shards`` numbers.
    """
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast(ENTRY).alias("out"))
    ordered = loads.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("k"), "vslot", "bytes", "rows"))).alias("s"))
    placed = ordered.select(F.explode(F.aggregate("s", start, _place, lambda a: a["out"])).alias("p"))
    return placed.select(F.lit(version).alias("version"), "p.*")


def grow(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with one more shard (number ``shards``): slots move only into the new shard.

    Of each old shard, the smallest slots whose running bytes stay within its surplus over the new mean go.
    """
    w = Window.partitionBy("shard")
    m = current.withColumn("mean", F.sum("bytes").over(Window.partitionBy("version")) / (shards + 1))
    m = m.withColumn("surplus", F.sum("bytes").over(w) - F.col("mean"))
    run = F.sum("bytes").over(w.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    moved = m.withColumn("shard", F.when(run <= F.col("surplus"), F.lit(shards)).otherwise(F.col("shard")))
    return moved.select((F.col("version") + 1).alias("version"), "vslot", "bytes", "rows", "shard")


def rebalance(current: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version for new ``loads``: slots of shards over (1 + tolerance) x mean leave until the shard is back at the
    mean, and go to the shards with room, largest first; slots of other shards stay. New slots count as leaving."""
    now = loads.join(F.broadcast(current.select("vslot", "shard", "version")), "vslot", "left")
    whole = Window.partitionBy(F.lit(0))  # SLOTS rows at most
    now = now.withColumn("version", F.coalesce(F.max("version").over(whole), F.lit(0)) + 1).withColumn("mean", F.sum("bytes").over(whole) / shards)
    w = Window.partitionBy("shard")
    now = now.withColumn("load", F.sum("bytes").over(w))
    run = F.sum("bytes").over(w.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    leaves = F.col("shard").isNull() | ((F.col("load") > F.col("mean") * (1 + tolerance)) & (run <= F.col("load") - F.col("mean")))
    now = now.withColumn("leaves", leaves)
    loads_now = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate(F.filter("all", lambda x: (x["shard"] == i) & ~x["leaves"]), F.lit(0).cast("long"), lambda t, x: t + x["bytes"]))
    goers = F.array_sort(F.transform(F.filter("all", lambda x: x["leaves"]), lambda x: F.struct((-x["bytes"]).alias("k"), x["vslot"].alias("vslot"), x["bytes"].alias("bytes"), x["rows"].alias("rows"))))
    one = now.groupBy("version").agg(F.collect_list(F.struct("vslot", "bytes", "rows", "shard", "leaves")).alias("all"))
    placed = one.select("version", F.explode(F.aggregate(goers, F.struct(loads_now.alias("load"), F.array().cast(ENTRY).alias("out")), _place, lambda a: a["out"])).alias("p")).select("version", "p.*")
    return now.filter(~F.col("leaves")).select("version", "vslot", "bytes", "rows", "shard").unionByName(placed)


def shard_rows(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` (of ``sized``) with ``shard`` and ``slot``, the row's position in its shard, gapless from 0.

    A position is the slot's offset in its shard plus the row's number in the slot, so no task sees a whole shard. The map
    has SLOTS rows, so it is broadcast.
    """
    w = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.withColumn("offset", F.coalesce(F.sum("rows").over(w), F.lit(0))).select("vslot", "shard", "offset")
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("n", inside).join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("offset") + F.col("n") - 1).cast("long")).drop("n", "offset")


def store(current: DataFrame, path: str) -> None:
    """Write one version of a map beside the ones before it."""
    current.write.mode("append").partitionBy("version").parquet(path)


MAP = "vslot int, bytes bigint, rows bigint, shard int, version int"


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the map stored at ``path``; None if there is none."""
    try:
        every = spark.read.schema(MAP).parquet(path)
    except AnalysisException:  # nothing there yet
        return None
    last = every.agg(F.max("version")).first()[0]
    return None if last is None else every.filter(F.col("version") == last).select("version", "vslot", "bytes", "rows", "shard")


def levelled(current: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.02) -> bool:
    """Whether the map knows all slots of ``loads`` with their rows, and no shard has over (1 + tolerance) x the mean."""
    j = loads.join(F.broadcast(current.select("vslot", "shard", F.col("rows").alias("was"))), "vslot", "left")
    by = j.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count_if(~F.col("rows").eqNullSafe(F.col("was"))).alias("moved"))
    row = by.agg(F.max("b").alias("top"), F.sum("b").alias("all"), F.sum("moved").alias("moved")).first()
    return not row["all"] or (row["moved"] == 0 and row["top"] <= row["all"] / shards * (1 + tolerance))


def assign(docs: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` shards, under the law ``bytes``.

    ``path`` is where the versions of the map live; a new folder in the shared one if not given. Without a stored version the first
    is made; if loads have moved, the newest is edited and stored as the next.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark)
    rows = sized(docs)
    loads = saved(slot_bytes(rows))
    current = newest(spark, path)
    if current is None:
        store(slot_map(loads, shards), path)
    elif not levelled(current, loads, shards):
        store(saved(rebalance(current, loads, shards)), path)
    current = newest(spark, path)
    if current is None:  # an empty table has no slots
        current = spark.createDataFrame([], "version int, vslot int, bytes bigint, rows bigint, shard int")
    out = shard_rows(rows, current)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
