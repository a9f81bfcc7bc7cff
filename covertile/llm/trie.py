"""Prefix trie of conversations by burst tries.

A turn is (role, text), told by 16 bytes of its SHA-256; a node is a distinct sequence of first turns, its members are the conversations
that start with it. Equal conversations are one entry with a weight. All entries begin in one container under the root.
A container of over ``most`` entries bursts: the turns that all its entries share become a chain of nodes, and the next turn's
id deals the entries to containers under new heads. Containers that fit are dealt to tasks by head, sorted and swept: neighbours'
common turns open and close nodes, whose counts are summed on the way up. Burst nodes sum their heads' counts, round by round.
A burst that starts with the container's first and last entry (their common turns are all entries' common turns) always parts
it, so the rounds are the branchings along a path that hold over ``most`` entries below them, not the turns.

Memory: a task holds one path and the closed nodes of one container; the member ids of an entry are joined in pieces of up to 4,096 ids
and digested as a stream, however many copies a conversation has.

Cases: null roles and texts are empty; turns that are null come first, ties go by role, then text; repeated rows are turns of their own;
rows without a conversation id belong to no conversation; a conversation without turns ends at the root; without any
conversation there is no node. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.llm.common import lookup, saved, tuned

#: Entries that one task sorts and sweeps as one container.
CONTAINER = 4096
#: Ids of one conversation's copies that one row joins; pieces are digested in order.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [f.split(" ")[0] for f in NODE.split(", ")]


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation, numbered from 1."""
    turns = rows.filter("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return turns.select("conv_id", pos.cast("long").alias("pos"), "role", "text")


def _digest(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def entries(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv, n, seq, words, ends): one row for each distinct sequence of turns: smallest member, members, turn ids, words of each turn's text,
    digest of the members. ``conversations`` (conv_id) adds those that have no rows."""
    turn = F.struct("pos", _digest(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("id"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    seqs = numbered(rows).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    if conversations is not None:
        seqs = conversations.select("conv_id").filter("conv_id is not null").distinct().join(seqs, "conv_id", "left")
    empty = F.expr("array()")
    parts = seqs.select("conv_id", F.coalesce(F.col("t.id"), empty.cast("array<binary>")).alias("seq"), F.coalesce(F.col("t.words"), empty.cast("array<bigint>")).alias("words"))
    sid = _digest(F.array_join(F.transform("seq", F.hex), ","))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = (
        parts.withColumn("sid", sid).withColumn("piece", F.floor(F.col("conv_id") / PIECE)).groupBy("sid", "piece")
        .agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), ids.alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # sid, seq, words, n, conv, digest; the next batch may go on with it
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is not None and now[0] == r["sid"]:
                    now[3] += r["n"]
                    now[4] = min(now[4], r["conv"])
                    now[5].update(b"," + r["ids"].encode())
                else:
                    if now is not None:
                        out.append(now)
                    now = [r["sid"], r["seq"], r["words"], r["n"], r["conv"], hashlib.sha256(r["ids"].encode())]
            yield _entries(out)
        if now is not None:
            yield _entries([now])

    return pieces.repartition("sid").sortWithinPartitions("sid", "piece").mapInArrow(run, "conv long, n long, seq array<binary>, words array<long>, ends string")


def _entries(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.string()]
    cols = [[r[4] for r in rows], [r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[5].hexdigest() for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "n", "seq", "words", "ends"])


class _Node:
    __slots__ = ("children", "closed", "conv", "ends", "leaves", "n", "saved", "words")

    def __init__(self, words: int) -> None:
        self.words, self.n, self.conv, self.children, self.leaves, self.saved, self.ends = words, 0, None, 0, 0, 0, EMPTY
        self.closed: list[tuple] = []  # children that wait for this node's smallest member

    def takes(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose entries come sorted: (head, the node's columns); head only at the container's first node."""
    head, path, before, above, start = None, [], [], None, 0
    done: list[tuple] = []

    def close(top: bytes | None) -> None:
        """Close the last node of the path; ``top`` is its container's head if it is the first."""
        v = path.pop()
        v.leaves = v.leaves or 1
        v.saved += (v.n - 1) * v.words
        row = (v.conv, start + len(path), v.n, v.children, v.leaves, v.saved, v.ends)
        done.extend((None, c[0], c[1], v.conv, *c[2:]) for c in v.closed)
        if top is not None:
            done.append((top, row[0], row[1], above, *row[2:]))
            return
        up = path[-1]
        up.takes(v.n, v.conv)
        up.children += 1
        up.leaves += v.leaves
        up.saved += v.saved
        up.closed.append(row)

    def finish() -> None:
        while len(path) > 1:
            close(None)
        if path:
            close(head)

    for batch in batches:
        for r in batch.to_pylist():
            seq, words = r["seq"], r["words"]
            if r["head"] != head:
                finish()
                head, above, start, before = r["head"], r["above"], r["at"], seq
                path.append(_Node(words[start - 1] if start else 0))
            shared = start
            most = min(len(before), len(seq))
            while shared < most and before[shared] == seq[shared]:
                shared += 1
            while start + len(path) - 1 > shared:
                close(None)
            for d in range(start + len(path), len(seq) + 1):
                path.append(_Node(words[d - 1]))
            path[-1].takes(r["n"], r["conv"])
            path[-1].ends = r["ends"]
            before = seq
        yield _nodes(done)
        done.clear()
    finish()
    yield _nodes(done)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["head", *NAMES])


def _burst(rows: DataFrame, big: DataFrame) -> DataFrame:
    """The entries of oversized containers, each under the head that its next turn makes; those that end at the burst node stay there (child null)."""
    held = lookup(rows, big.select("head", "common", F.col("conv").alias("top"), "rows"), "head", "rows").filter("common is not null")
    nxt = F.when(F.size("seq") > F.col("common"), _digest(F.concat("head", F.element_at("seq", (F.col("common") + 1).cast("int")))))
    return held.select(nxt.alias("child"), F.col("head").alias("parent"), F.col("top").alias("above"), (F.col("common") + 1).alias("at"), "conv", "n", "seq", "words", "ends")


def nodes(rows: DataFrame, conversations: DataFrame | None = None, most: int = CONTAINER) -> DataFrame:
    """One row for each node: conv_id (smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, the words of a node's last text times its members but one), ends_sha256 (of the members that end there)."""
    tuned(rows.sparkSession)
    root = F.unhex(F.lit("00" * 16))
    kept = entries(rows, conversations).select(root.alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("above"), F.lit(0).cast("long").alias("at"), "conv", "n", "seq", "words", "ends")
    live = saved(kept)
    closed, bursts = [], []
    first, last = F.min(F.struct("seq", "words")), F.max("seq")
    while True:
        stats = live.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("parent").alias("parent"), F.first("above").alias("above"), F.first("at").alias("at"), first.alias("lo"), last.alias("hi"))
        short = F.least(F.size("lo.seq"), F.size("hi"))
        differs = F.array_position(F.zip_with(F.slice("lo.seq", 1, short), F.slice("hi", 1, short), lambda x, y: x != y), True)
        stats = saved(stats.withColumn("common", F.when(short == 0, 0).otherwise(F.when(differs > 0, differs - 1).otherwise(short)).cast("long")).drop("hi"))
        bursts.append([stats, None, None])
        big = stats.filter(F.col("rows") > most)
        if big.isEmpty():
            closed.append(live)
            break
        small = lookup(live, big.select("head", "rows", F.lit(True).alias("big")), "head", "rows").filter("big is null").drop("big")
        closed.append(small)
        dealt = saved(_burst(live, big))
        bursts[-1][1:] = big, dealt.filter("child is null").select(F.col("parent").alias("head"), "ends")
        live = dealt.filter("child is not null").withColumnRenamed("child", "head")
    whole = reduce(DataFrame.unionByName, [c.select("head", "above", "at", "conv", "n", "seq", "words", "ends") for c in closed])
    swept = saved(whole.repartition("head").sortWithinPartitions("head", "seq").mapInArrow(_sweep, f"head binary, {NODE}"))
    found, sums = [swept.select(*NAMES)], swept.filter("head is not null").select("head", "n_leaves", "saved_tokens")
    for k in range(len(bursts) - 2, -1, -1):
        _, big, ends = bursts[k]
        below = bursts[k + 1][0].select("head", "parent").join(sums, "head").groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        tops = big.join(below.withColumnRenamed("parent", "head"), "head").join(ends, "head", "left")
        # the chain from its deepest node up: what each node's turn saves counts for it and all above
        chain = tops.select("*", F.explode(F.sequence("at", "common")).alias("depth"))
        words = F.slice(F.col("lo.words"), F.greatest(F.col("depth"), F.lit(1)).cast("int"), F.greatest(F.col("common") - F.greatest(F.col("depth"), F.lit(1)) + 1, F.lit(0)).cast("int"))
        total = F.col("below") + (F.col("n") - 1) * F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)
        deep = F.col("depth") == F.col("common")
        made = saved(chain.select(F.when(F.col("depth") == F.col("at"), F.col("head")).alias("head"), F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("at"), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(deep, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), total.alias("saved_tokens"), F.when(deep, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256")))
        found.append(made.select(*NAMES))
        sums = sums.unionByName(made.filter("head is not null").select("head", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, found)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) as the registered query reads them: conversation c begins with the first crc32(c) mod 4 turns of conversation
    c - c mod 20, then has its own turns after its first so many."""
    turns = saved(numbered(rows))
    ids = turns.select("conv_id").distinct()
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    first = turns.filter("conv_id % 20 = 0 and pos <= 3").withColumnRenamed("conv_id", "base")
    lent = ids.withColumn("base", F.expr("conv_id - conv_id % 20")).join(first, "base").filter(F.col("pos") <= h)
    names = ["conv_id", F.col("pos").alias("turn"), "role", "text"]
    return turns.filter(F.col("pos") > h).select(*names).unionByName(lent.select(*names)), ids
