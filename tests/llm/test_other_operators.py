"""Nearest neighbours, sharding, chat and the registered queries."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from covertile.llm import ann, chat, queries, sharding


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(16)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[100:160] = v[0]  # a vector that many share
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, None]), (1400, [1.0, 2.0]), (1401, [1.0, 3.0]), (1500, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 100 = 0"), 10).toPandas()
    hit = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], d[own["vec_id"]], atol=0)
        hit, total = hit + len(set(want) & set(own["vec_id"])), total + 10
    assert hit / total >= 0.9
    assert got[got["query_id"] == 0]["vec_id"].tolist() == list(range(100, 110))
    assert got[got["query_id"] == 1400]["vec_id"].tolist() == [1401]
    assert not set(got["query_id"]) & {1000, 1100, 1200, 1300, 1500}
    assert ann.nearest(df.limit(0), df.filter("vec_id = 0"), 3).count() == 0


def test_shards_are_level_and_gapless(spark):
    rng = np.random.default_rng(17)
    rows = [(i, "é" * int(rng.integers(0, 3000))) for i in range(4000)] + [(7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, 40).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 40 and by.max() / by.mean() < 1.01
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    one = got[got["doc_id"] == 5].iloc[0]
    assert one["size"] == len(rows[5][1].encode()) + 16 and one["text_crc32"] == zlib.crc32(rows[5][1].encode())
    assert set(got[got["doc_id"] == 7]["size"]) >= {16}
    assert sharding.assign(df.limit(0), 40).count() == 0


def test_maps_are_edited(spark):
    loads = spark.createDataFrame([(i, (i * 7919) % 1000 + 1, 1) for i in range(500)], "vslot int, bytes long, rows long")
    m = sharding.slot_map(loads, 8).persist()
    g = sharding.grow(m, 8).persist()
    j = g.select("vslot", F.col("shard").alias("now")).join(m, "vslot")
    assert j.filter("now <> shard and now <> 8").count() == 0 and g.filter("shard = 8").count() > 0
    assert {r.version for r in g.collect()} == {2}
    heavy = loads.withColumn("bytes", F.when(F.col("vslot") < 60, F.col("bytes") * 5).otherwise(F.col("bytes")))
    r = sharding.rebalance(g, heavy, 9).groupBy("shard").agg(F.sum("bytes").alias("b")).toPandas()
    assert len(r) == 9 and r["b"].max() / r["b"].mean() < 1.1
    assert sharding.rebalance(g, heavy, 9).count() == 500


def test_the_stored_map_is_read_and_edited(spark, tmp_path):
    rng = np.random.default_rng(23)
    path = str(tmp_path / "map")
    rows = [(None if i % 3 == 0 else i, "x" * int(rng.integers(0, 3000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {(r.doc_id, r.text_crc32, r.size): r.shard for r in sharding.assign(df, 8, path).collect()}
    assert sharding.newest(spark, path).first().version == 1
    again = {(r.doc_id, r.text_crc32, r.size): r.shard for r in sharding.assign(df, 8, path).collect()}
    assert again == first and sharding.newest(spark, path).first().version == 1
    more = df.unionByName(spark.createDataFrame([(10_000 + i, "y" * 20_000) for i in range(100)], "doc_id long, text string"))
    moved = sharding.assign(more, 8, path).toPandas()
    assert sharding.newest(spark, path).first().version == 2
    by = moved.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() / by.mean() < 1.05
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in moved.groupby("shard"))
    same = sum(first.get((None if np.isnan(r.doc_id) else int(r.doc_id), r.text_crc32, r.size)) == r.shard for r in moved.itertuples())
    assert same > 0.7 * len(rows)  # an edit leaves most where they are


def test_shards_equal_brute_force(spark):
    rng = np.random.default_rng(24)
    docs = spark.createDataFrame([(i, "z" * int(rng.integers(0, 500))) for i in range(800)], "doc_id long, text string")
    got = sharding.assign(docs, 5).toPandas()
    load = got.groupby("virtual_slot")["size"].sum().reset_index().sort_values(["size", "virtual_slot"], ascending=[False, True])
    total, place = [0] * 5, {}
    for v, b in zip(load["virtual_slot"], load["size"], strict=True):
        place[v] = total.index(min(total))
        total[place[v]] += b
    assert all(place[r.virtual_slot] == r.shard for r in got.itertuples())


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_read_back(spark):
    odd = "<|end|><|user|>x<\\|end|> < | <\\\\| é😀\n"
    rows = [(1, 2, "assistant", odd), (1, 1, "user", None), (1, 3, "us|>%7C", "<|"), (2, 5, "assistant", ""), (3, None, None, "a"), (3, None, None, "a")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(37)]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {1: [("user", ""), ("assistant", odd), ("us|>%7C", "<|")], 2: [("assistant", "")], 3: [("unknown", "a")] * 2, 4: [(r[2], r[3]) for r in rows if r[0] == 4]}
    for c, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == 4
    assert chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_best_branch_of_a_tree(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (1, 5, 4, 0.0), (1, 6, 99, 3.0)]
    df = spark.createDataFrame([(*n, "user", f"m{n[1]}") for n in nodes], "tree long, node long, parent long, score double, role string, text string")
    path = chat.chosen_paths(df, 2).collect()
    assert sorted(r.node for r in path if r.branch == 1) == [1, 3, 4, 5]
    assert sorted(r.node for r in path if r.branch == 2) == [1, 2]
    assert sorted(r.formatted for r in chat.formatted(df, 1).collect()) == ["".join(f"<|user|>m{i}<|end|>" for i in (1, 3, 4, 5))]


def test_cycles_and_repeated_nodes(spark):
    nodes = [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 1, 1.0), (1, 4, 2, 9.0), (2, 7, 7, 1.0), (3, 1, None, 1.0), (3, 1, None, 1.0), (3, 2, 1, 1.0), (3, 2, 1, 1.0)]
    df = spark.createDataFrame([(*n, "user", f"m{n[1]}") for n in nodes], "tree long, node long, parent long, score double, role string, text string")
    # on the cycle 1 -> 2 -> 3 -> 1 node 1 is the root, so 1, 3, 2, 4 is the best path
    assert sorted(tuple(r) for r in chat.chosen_paths(df).collect()) == [(1, 1, 1, 1), (1, 1, 2, 3), (1, 1, 3, 2), (1, 1, 4, 4), (2, 1, 7, 1), (3, 1, 1, 1), (3, 1, 2, 2)]
    assert {r.tree: r.formatted for r in chat.formatted(df).collect()}[3] == "<|user|>m1<|end|><|user|>m2<|end|>"


def test_a_query_row_that_stands_twice_is_one_query(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [0.0, 4.0]), (3, [0.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 3.0), (0, 3, 3, 7.0)]


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.toPandas()
    v = np.stack(rows["embedding"]).astype(float)
    got = ann.nearest(df, df.filter("vec_id % 100 = 0"), 10).toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = 0
    for q in got.index:
        i = int(np.flatnonzero(rows["vec_id"] == q)[0])
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        want = [int(x) for x in rows["vec_id"].to_numpy()[np.lexsort((rows["vec_id"], d))] if x != q][:10]
        hit += len(set(want) & got[q])
    assert hit / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_messages_without_a_tree_are_one_tree(spark, limit):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "bc"), (None, 2, "user", "d"), (0, 0, "user", "e"), (0, 1, "assistant", "f")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r for r in chat.report(df).collect()}
        path = {(r.tree, r.branch, r.node, r.depth) for r in chat.chosen_paths(chat.threads(df)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {(c, r.n_turns, r.loss_chars) for c, r in got.items()} == {(None, 3, 2), (0, 2, 1)}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nbc\nuser\nd\n").hexdigest()
    assert path == {(None, 1, 1, 1), (None, 1, 2, 2), (None, 1, 3, 3), (0, 1, 1, 1), (0, 1, 2, 2)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    table = {"op2": "embeddings", "op10": "conversations", "op12": "conversations"}.get(name.split("_")[0], "documents")
    if table == "documents":
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    elif name.startswith("op12_"):
        # a row for each node: the root has every conversation
        assert df.filter("depth = 0").first().n_convs == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert df.count() > 0
