"""From alignments to counts and covered bases of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.functions import aligned_bases, cigar_blocks, reference_end, whole_div, window_of
from covertile.plans.tables import saved

PIPELINE_MASK = 1796
RANGE_MASK = 2308


def passing(reads: DataFrame, min_mapq: int = 0, exclude_flags: int = PIPELINE_MASK) -> DataFrame:
    """Mapped reads of at least ``min_mapq`` without any of the flag bits."""
    return reads.filter(F.col("rname").isNotNull() & (F.col("rname") != "*") & (F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(F.lit(exclude_flags)) == 0))


def with_sample(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Reads with their read group's sample; a missing or undeclared read group is an error, unrequested samples go.

    ``read_groups`` (rg, sample, requested) comes from file headers; Spark broadcasts it if it is small.
    """
    j = reads.join(read_groups, "rg", "left")
    bad = F.raise_error(F.concat(F.lit("read group not declared: "), F.coalesce("rg", F.lit("none")))).cast("boolean")
    return j.filter(F.when(F.col("requested").isNull(), bad).otherwise(F.col("requested"))).drop("requested")


def blocks(reads: DataFrame, count_deletions: bool = False) -> DataFrame:
    """(read, sample, chr_id, mapq, strand, aligned, start, stop): a row for each aligned block of each read."""
    b = F.explode(cigar_blocks("cigar", "pos", count_deletions))
    return reads.select("read", "sample", F.col("rname").alias("chr_id"), "mapq", (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("reverse"), aligned_bases("cigar").alias("aligned"), F.col("pos").alias("read_pos"), b.alias("b")).select("*", F.col("b.s").alias("start"), F.col("b.e").alias("stop")).drop("b")


def in_windows(intervals: DataFrame, contigs: DataFrame, n: int) -> DataFrame:
    """Intervals (chr_id, start, stop) with a row for each window they overlap, clipped to it.

    The window's number is arithmetic, so no range join is needed: first and last base give the first and last window.
    """
    length, m = F.col("length"), F.lit(n).cast("long")
    j = intervals.join(contigs.select("chr_id", "length"), "chr_id").filter("stop > start")
    iids = F.sequence(window_of(F.col("start"), length, m), window_of(F.col("stop") - 1, length, m))
    w = j.withColumn("iid", F.explode(iids))
    lo, hi = whole_div(F.col("iid") * length, m), whole_div((F.col("iid") + 1) * length, m)
    return w.withColumns({"clip_start": F.greatest("start", lo), "clip_stop": F.least("stop", hi)}).drop("length")


def union_length(rows: DataFrame, keys: list[str], start: str = "clip_start", stop: str = "clip_stop") -> DataFrame:
    """(keys, covered): bases under at least one interval.

    Of the intervals that begin at one place only the longest matters. That maximum is taken before the shuffle, so what meets in the task of a key
    is at most a row for each of its places, however many intervals it has.
    """
    longest = rows.filter(F.col(stop) > F.col(start)).groupBy(*keys, F.col(start).alias("_a")).agg(F.max(stop).alias("_b"))
    far = F.max("_b").over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_b") - F.greatest(F.col("_a"), F.coalesce(far, F.col("_a"))))
    return longest.withColumn("_new", new).groupBy(*keys).agg(F.sum("_new").cast("long").alias("covered"))


def count_windows(pieces: DataFrame, high_mapq: int = 30, sums: dict[str, Column] | None = None, slices: int = 4, read: str = "read") -> DataFrame:
    """(sample, chr_id, iid, count, mapq_high, covered, …): reads count once in a window, all their blocks cover.

    ``pieces`` are rows of ``in_windows`` with mapq and a column ``read`` that tells reads apart, by its 64-bit hash; a read's mapping quality in a
    window is its best. ``sums`` are further sums over the pieces, by name. Pieces are written once, narrow, and grouped in two ways without a sort: by read, as rows of three
    numbers, and by stretch of ``slices`` times 64 bases, as bits. The stretches of a window are few and a split of the table has millions of pieces, so most
    pieces meet their stretch before the shuffle. The rows of reads name sample, contig and window by a hash; the rows of bases know them.
    """
    keys, sums = ["sample", "chr_id", "iid"], sums or {}
    size = 64 * slices
    p = saved(pieces.select(*keys, "mapq", "clip_start", (F.col("clip_stop") - F.col("clip_start")).alias("_size"), F.xxhash64(read).alias("_read"), *(c.alias(f"_s_{k}") for k, c in sums.items())))
    of = F.xxhash64("sample", F.lit(0), "chr_id", F.lit(0), "iid").alias("_of")
    seen = p.groupBy(of, "_read").agg(F.max("mapq").alias("mapq"))
    seen = seen.groupBy("_of").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("mapq") >= high_mapq).alias("mapq_high"))

    first, last = whole_div(F.col("clip_start"), F.lit(size)), whole_div(F.col("clip_start") + F.col("_size") - 1, F.lit(size))
    at = p.withColumns({"_first": first, "_at": F.explode(F.sequence(first, F.greatest(first, last)))})
    a = F.col("clip_start") - F.col("_at") * size

    def bits(i: int) -> Column:
        lo, hi = (F.greatest(F.lit(0), F.least(F.lit(64), c - 64 * i)).cast("int") for c in (a, a + F.col("_size")))
        every = F.lit(-1).cast("long")
        return F.when(lo < hi, F.call_function("shiftleft", every, lo).bitwiseAND(F.call_function("shiftrightunsigned", every, 64 - hi))).otherwise(F.lit(0).cast("long"))

    names = [f"_m{i}" for i in range(slices)]
    once = at.groupBy(*keys, "_at").agg(*(F.bit_or(bits(i)).alias(m) for i, m in enumerate(names)), *(F.sum(F.when(F.col("_at") == F.col("_first"), F.col(f"_s_{k}"))).alias(k) for k in sums))
    covered = sum((F.bit_count(m) for m in names[1:]), F.bit_count(names[0]))
    bases = once.groupBy(*keys).agg(F.sum(covered).alias("covered"), *(F.sum(k).alias(k) for k in sums)).select(*keys, of, "covered", *sums)
    whole = bases.unionByName(seen, allowMissingColumns=True).groupBy("_of").agg(*(F.max(c).alias(c) for c in keys), *(F.sum(c).alias(c) for c in ("count", "mapq_high", "covered", *sums)))
    return whole.select(*keys, "count", "mapq_high", F.col("covered").cast("long").alias("covered"), *sums)


def on_grid(counts: DataFrame, windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Every window of every sample, zero where nothing fell: the grid is the result's own size."""
    every = windows.crossJoin(samples.select("sample").distinct())
    out = every.join(counts, ["sample", "chr_id", "iid"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count", "mapq_high", "covered")})


def read_length(pieces: DataFrame) -> DataFrame:
    """(sample, read_length): aligned bases of the sample's first read, by contig order, window and position."""
    first = F.struct("ord", "iid", "read_pos", "read")
    return pieces.groupBy("sample").agg(F.min_by("aligned", first).alias("read_length"))


#: A position as digits of 7 bits, from the lowest; LEVELS of them hold any position under 2^42.
BITS, LEVELS = 7, 6


def _digits(pos: Column) -> Column:
    """array<struct(level, parent, digit)> of a position: at each level the node that its higher digits name, and the digit in it."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(pos, BITS * (k + 1)).alias("parent"), F.shiftright(pos, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("digit")) for k in range(LEVELS)))


def ranks(points: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (chr_id, at, …) with ``rank``: how many ``points`` (chr_id, pos) of the contig lie before ``at``; positions from 0 to 2^42 - 1.

    A tree of digits: each node knows how many points each of its up to 128 children has. Before a place lie, at each level, the smaller
    siblings of its digit, so a place looks up LEVELS nodes, wherever it is. Points are counted by position, then by child, before they move.
    The lowest nodes are written once, as both the nodes above and the places read them.
    """
    digit = lambda c, k=0: F.shiftright(c, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    deep = points.groupBy("chr_id", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    lowest = deep.groupBy("chr_id", F.shiftright("pos", BITS).alias("parent")).agg(F.collect_list(F.struct(digit(F.col("pos")).alias("digit"), "n")).alias("children"), F.sum("n").alias("n"))
    lowest = saved(lowest)
    above = lowest.select("chr_id", "n", F.explode(F.slice(_digits(F.shiftleft("parent", BITS)), 2, LEVELS)).alias("d")).groupBy("chr_id", "d.level", "d.parent", "d.digit").agg(F.sum("n").alias("n"))
    nodes = above.groupBy("chr_id", "level", "parent").agg(F.collect_list(F.struct("digit", "n")).alias("children")).unionByName(lowest.select("chr_id", F.lit(0).alias("level"), "parent", "children"))
    asked = places.select("chr_id", "at").distinct()
    clipped = F.least(F.greatest(F.col("at").cast("long"), F.lit(0).cast("long")), F.lit((1 << (BITS * LEVELS)) - 1).cast("long"))
    look = asked.select("chr_id", "at", F.explode(_digits(clipped)).alias("d")).select("chr_id", "at", "d.level", "d.parent", "d.digit")
    found = look.join(nodes, ["chr_id", "level", "parent"]).select("chr_id", "at", F.aggregate(F.filter("children", lambda c: c["digit"] < F.col("digit")), F.lit(0).cast("long"), lambda t, c: t + c["n"]).alias("n"))
    total = found.groupBy("chr_id", "at").agg(F.sum("n").alias("rank"))
    return places.join(total, ["chr_id", "at"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def count_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (range_id, chr_id, start, stop) with the number of ``points`` (chr_id, pos) inside each; zeros stay.

    Ranges may overlap and each counts by itself: points before its stop less points before its start, so a long range costs
    what a short one does.
    """
    ends = ranges.filter("stop > start").select("range_id", "chr_id", F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("stop").cast("long").alias("at"), F.lit(1).alias("sign")))).alias("e")).select("range_id", "chr_id", "e.at", "e.sign")
    hits = ranks(points, ends).groupBy("range_id").agg(F.sum(F.col("sign") * F.col("rank")).cast("long").alias("n"))
    return ranges.join(hits, "range_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def five_prime(reads: DataFrame) -> DataFrame:
    """(chr_id, pos) of each read's 5' end: its start, or its last base on the reverse strand."""
    reverse = F.col("flag").bitwiseAND(F.lit(16)) != 0
    return reads.select(F.col("rname").alias("chr_id"), F.when(reverse, reference_end("cigar", "pos") - 1).otherwise(F.col("pos")).alias("pos"))


def count_reads(reads: DataFrame, ranges: DataFrame, min_mapq: int = 20, exclude_flags: int = RANGE_MASK) -> DataFrame:
    return count_ranges(five_prime(passing(reads, min_mapq, exclude_flags)), ranges)
