"""Planted cases, properties and invariants of single operators."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from covertile import functions as fn
from covertile import params, schemas
from covertile.operators import assign, calibrate, classify, explore, intervals, mask, matching, metrics, payload, reads, registry, robust, scoring, segment, tiling
from covertile.params import Params
from covertile.plans import mapping as mp
from covertile.plans import surface
from covertile.sources import ranges, readers, writers


def test_finite_turns_nan_and_infinity_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.x for r in fn.finite_all(df).collect()] == [1.0, None, None, None]


def test_tiling_is_exact_for_random_lengths(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", rng.randint(50, 10**12)) for i in range(30)] + [("short", 10)]
    w = tiling.tile(spark.createDataFrame(rows, "chr_id string, length long"), 37)
    assert tiling.gaps(w).count() == 0
    got = {r.chr_id: (r.a, r.b, r.n) for r in w.groupBy("chr_id").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.count("*").alias("n")).collect()}
    assert got == {c: (0, n, 37) for c, n in rows if n >= 37}


def test_window_of_agrees_with_borders(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        length, n = rng.randint(1, 5000), rng.randint(1, 300)
        if n <= length:
            p = rng.randrange(length)
            rows.append((p, length, n, next(i for i in range(n) if i * length // n <= p < (i + 1) * length // n)))
    df = spark.createDataFrame(rows, "p long, l long, n long, want long")
    assert df.filter(fn.window_of(F.col("p"), F.col("l"), F.col("n")) != F.col("want")).count() == 0


def test_counts_and_cover_of_hand_written_reads(spark):
    contigs = spark.createDataFrame([("c", 100)], "chr_id string, length long")
    lines = [("r1", 0, 5, "10M"), ("r2", 0, 8, "2M3D2M"), ("r3", 0, 15, "3M5N4M"), ("r4", 16, 95, "2S5M"), ("r5", 4, 1, "9M"), ("r6", 0, 90, "5M5I")]
    raw = spark.createDataFrame([(q, "S", f, "c", p, 60, c) for q, f, p, c in lines], "read string, sample string, flag int, rname string, pos long, mapq int, cigar string")
    pieces = reads.in_windows(reads.blocks(reads.passing(raw, 20)), contigs, 10)
    got = {r.iid: (r["count"], r.covered) for r in reads.count_windows(pieces).collect()}
    covered, seen = [set() for _ in range(10)], [set() for _ in range(10)]
    for q, bases in (("r1", range(5, 15)), ("r2", [8, 9, 13, 14]), ("r3", [15, 16, 17, 23, 24, 25, 26]), ("r4", range(95, 100)), ("r6", range(90, 95))):
        for b in bases:
            covered[b // 10].add(b)
            seen[b // 10].add(q)
    assert got == {i: (len(seen[i]), len(covered[i])) for i in range(10) if covered[i]}
    ends = {r.pos for r in reads.five_prime(raw.filter("read in ('r3', 'r4')")).collect()}
    assert ends == {15, 99}


def test_range_counts_against_brute_force(spark):
    rng = random.Random(3)
    points = [("c", rng.randrange(100_000)) for _ in range(400)]
    ranges = [(i, "c", a := rng.randrange(100_000), a + rng.choice([0, 1, 50, 40_000])) for i in range(60)]
    got = {r.range_id: r.n for r in reads.count_ranges(spark.createDataFrame(points, "chr_id string, pos long"), spark.createDataFrame(ranges, "range_id int, chr_id string, start long, stop long")).collect()}
    assert got == {i: sum(a <= p < b for _, p in points) for i, _, a, b in ranges}


def test_undeclared_read_group_is_an_error(spark):
    r = spark.createDataFrame([("x", "q")], "rg string, read string")
    g = spark.createDataFrame([("a", "S", True)], "rg string, sample string, requested boolean")
    with pytest.raises(Exception, match="not declared"):
        reads.with_sample(r, g).collect()


def test_interval_merge_and_compression(spark):
    rng = random.Random(4)
    rows = [("k", a := rng.randrange(300), a + rng.randrange(1, 20)) for _ in range(40)]
    under = set(itertools.chain.from_iterable(range(a, b) for _, a, b in rows))
    df = spark.createDataFrame(rows, "k string, start long, stop long")
    m = intervals.merge(df, ["k"], "start", "stop").collect()
    assert sum(r.stop - r.start for r in m) == len(under)
    points = spark.createDataFrame([("k", p) for p in range(0, 330, 7)], "k string, pos long")
    comp = intervals.removed_before(points, df, ["k"])
    assert {r.pos: r.removed for r in comp.collect()} == {p: sum(u < p for u in under) for p in range(0, 330, 7)}
    back = intervals.restored(comp.select("k", "pos", "kept_pos"), df, ["k"]).collect()
    assert all(r.original == r.pos for r in back if r.pos not in under and r.pos - 1 not in under)


def test_gap_merge_cases(spark):
    rows = [("a", 0, 4, 5, 2.0), ("a", 10, 14, 5, 3.0), ("a", 20, 24, 5, 4.0), ("b", 0, 4, 5, 2.0), ("b", 10, 14, 5, 0.1), ("b", 20, 24, 5, 2.0)]
    segs = spark.createDataFrame(rows, "k string, start_iid long, end_iid long, n_windows long, score_mean double")
    profile = spark.createDataFrame([(k, i, 0.0) for k in "ab" for i in range(25)], "k string, iid long, score double")
    got = sorted((r.k, r.start_iid, r.end_iid, r.n_windows, r.score_mean) for r in intervals.gap_merge(segs, profile, ["k"], 10, -1.0).collect())
    assert got == [("a", 0, 24, 25, 3.0), ("b", 0, 4, 5, 2.0), ("b", 10, 14, 5, 0.1), ("b", 20, 24, 5, 2.0)]


def test_choose_is_optimal():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(a := rng.randrange(12), a + rng.randrange(4), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 8))]
        best = 0
        for mask_ in range(1 << len(rows)):
            own = sorted(rows[i] for i in range(len(rows)) if mask_ >> i & 1)
            if all(a[1] < b[0] for a, b in zip(own[:-1], own[1:], strict=True)):
                best = max(best, sum(r[2] for r in own))
        assert sum(rows[i][2] for i in intervals.choose(rows)) == best


def test_select_non_overlapping_takes_many_groups_together(spark):
    rng = random.Random(7)
    rows = [(k if k else None, i, (a := rng.randrange(60)), a + rng.randint(0, 9), float(rng.randint(-1, 9)) + i / 64) for k in range(40) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "k long, i long, a long, b long, w double").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = intervals.select_non_overlapping(df, ["k"], "a", "b", "w")
        got = sorted(r.i + 100 * (r.k or 0) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    groups = [[r for r in rows if (r[0] or 0) == k] for k in range(40)]
    assert got == sorted(g[j][1] + 100 * k for k, g in enumerate(groups) for j in intervals.choose([r[2:] for r in g]))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # a call of Python for each group took 7 ms
    assert intervals.select_non_overlapping(df.filter("i < 0"), ["k"], "a", "b", "w").count() == 0


def test_alignment_lines_are_made_and_split_once(spark):
    line = "\t".join(["r1", "16", "d1", "11", "60", "50M", "*", "0", "0", "*", "*", "NM:i:0", "RG:Z:a"])
    lines = [line, line.replace("r1", "@r"), line.replace("60", "10"), line[: line.index("\tNM")], "a\tb", "", None]
    df = spark.createDataFrame([(v,) for v in lines], "v string").select(F.lit("f.sam").alias("path"), F.regexp_replace("v", "\r$", "").alias("value"))
    out = reads.passing(readers.alignments(df), 20)
    assert [(r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.rg) for r in out.orderBy("rg").collect()] == [("r1", 16, "d1", 10, 60, "50M", rg) for rg in (None, "a")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") == 1  # conditions had their own copies of the line


def test_points_of_ranges_are_read_once(spark):
    points = spark.range(3000).select(F.regexp_replace(F.lit("d1"), "x", "y").alias("chr_id"), (F.col("id") * 7).alias("pos"))
    wanted = spark.createDataFrame([(1, "d1", 0, 21000), (2, "d1", 7, 8), (3, "d1", 8, 14), (4, "d2", 0, 9)], "range_id long, chr_id string, start long, stop long")
    out = reads.count_ranges(points, wanted)
    assert {r.range_id: r.n for r in out.collect()} == {1: 3000, 2: 1, 3: 0, 4: 0}
    assert "regexp_replace(" not in out._jdf.queryExecution().optimizedPlan().toString()  # the nodes and those above each read the points


def test_five_prime_ends_split_each_line_once(spark, sf):
    plan = surface.five_prime_ends(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # each condition on reads had made and split the line anew


def brute_matching(edges):
    """Largest sum of gains of a one-to-one matching."""
    rights = sorted({b for _, b, _ in edges})
    best = {(): 0.0}  # rights that are taken -> gain
    for left in sorted({a for a, _, _ in edges}):
        step = dict(best)
        for taken, total in best.items():
            for a, b, g in edges:
                if a == left and b not in taken and g > 0:
                    key = tuple(sorted([*taken, b]))
                    step[key] = max(step.get(key, 0.0), total + g)
        best = step
    return max(best.values()), len(rights)


def test_auction_is_optimal():
    rng = random.Random(6)
    for _ in range(300):
        n, m = rng.randint(1, 9), rng.randint(1, 6)
        edges = [(a, b, rng.choice([1.0, 1e6]) * rng.choice([rng.uniform(-1, 5), rng.randint(0, 3)])) for a in range(n) for b in range(m) if rng.random() < 0.6]
        got = matching.auction(edges)
        gain = {(a, b): g for a, b, g in edges}
        assert len(set(got.values())) == len(got)
        want = brute_matching(edges)[0]
        assert math.isclose(sum(gain[a, b] for a, b in got.items()), want, rel_tol=1e-9, abs_tol=1e-4)
    assert matching.auction([]) == {}


def test_matching_by_components(spark):
    rng = random.Random(7)
    rows = [(s, f"c{a:02d}", f"r{b % 3 if s == 'x' else b}", rng.uniform(-2, 4)) for s in "xyz" for a in range(12) for b in range(6) if (b // 3 == a % 2 or s == "z") and rng.random() < 0.8]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "sample string, left string, right string, gain double").repartition(3)
    got = matching.best_matching(df, ["sample"]).collect()
    gain = {r[:3]: r[3] for r in rows}
    for s in "xyz":
        own = [r for r in got if r.sample == s]
        assert len({r.right for r in own}) == len({r.left for r in own}) == len(own)
        assert math.isclose(sum(gain[s, r.left, r.right] for r in own), brute_matching([r[1:] for r in rows if r[0] == s])[0], abs_tol=1e-4)
    parts = {(r.sample, r.right): r.component for r in matching.edge_components(df, ["sample"]).collect()}
    assert len({c for (s, _), c in parts.items() if s == "y"}) == 2 and len({c for (s, _), c in parts.items() if s == "z"}) == 1
    assert matching.best_matching(df.limit(0), ["sample"]).count() == 0


def test_many_lefts_need_no_dense_matrix(spark):
    n, m = 100_000, 12
    df = spark.range(n * m).select(F.lit("s").alias("sample"), F.expr(f"concat('c', id div {m})").alias("left"), F.expr(f"concat('r', id % {m})").alias("right"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e8).alias("gain"))
    got = matching.best_matching(df, ["sample"]).join(df, ["sample", "left", "right"]).collect()
    assert len(got) == m
    # the best of each right are different lefts here, or nearly so: the sum is that of the best ones or of next ones
    top = [r.g for r in df.groupBy("right").agg(F.max("gain").alias("g")).collect()]
    assert sum(top) - 0.01 <= sum(r.gain for r in got) <= sum(top) + 1e-9


def test_components_of_long_paths(spark):
    pairs = [("k", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30] + [("l", "n000", "n001")]
    nodes = [("k", f"n{i:03d}") for i in range(61)] + [("l", "n000"), ("l", "n001"), ("l", "n009")]
    got = {(r.s, r.node): r.component for r in matching.components(spark.createDataFrame(nodes, "s string, node string"), spark.createDataFrame(pairs, "s string, a string, b string"), ["s"]).collect()}
    assert all(got["k", f"n{i:03d}"] == ("n000" if i <= 30 else "n031") for i in range(61))
    assert got["l", "n001"] == "n000" and got["l", "n009"] == "n009"


def test_a_contig_goes_to_the_stronger_call(spark):
    cand = lambda c, chr_id, score, a, b, ok=True: ("s", c, chr_id, score, ok, a, b)
    rows = [cand("a", "r1", 3.0, 20, 39), cand("b", "r1", 2.0, 20, 39), cand("c", "r1", 1.0, 60, 70), cand("b", "r2", -1.0, 5, 9), cand("d", "r2", -1e6, 1, 4, False)]
    df = spark.createDataFrame(rows, "sample string, call_id string, chr_id string, score double, reliable boolean, run_start_iid long, run_end_iid long")
    calls = spark.createDataFrame([(c, True) for c in "abcd"], "call_id string, pass boolean")
    # c has a run of its own on r1, b's lies on a's; d and b's other candidate are none
    assert sorted((r.call_id, r.chr_id, r.second) for r in assign.match_hosts(df, calls).collect()) == [("a", "r1", False), ("c", "r1", True)]
    weak = spark.createDataFrame([("a", False), ("b", True), ("c", None), ("d", True)], "call_id string, pass boolean")
    assert ("b", "r1", False) in [tuple(r) for r in assign.match_hosts(df, weak).collect()]


def metrics_table(spark, samples=("S1",), planted=()):
    rng = np.random.default_rng(7)
    rows = []
    for s in samples:
        for role, comps in (("donor", ["S"]), ("recipient", ["A", "B"])):
            for g in ("1", "2"):
                for c in comps:
                    for i in range(120):
                        lam = 0.1 * math.exp(rng.normal(0, 0.02)) * (2.0 if (s, role, g) in planted and 50 <= i <= 90 else 1.0)
                        rows.append((s, f"{role[0]}{g}{c}", f"{g}{c}", g, role, c, 2.0, i, 0.4 + 0.1 * math.sin(i / 20), lam, lam, 1.0))
    return spark.createDataFrame(rows, "sample string, chr_id string, chr_name string, grp string, role string, component string, copy_number double, iid long, gc double, lambda_breadth double, lambda_count double, mapq_high_fraction double")


def test_planted_gain_is_segmented_and_noise_is_not(spark):
    m = metrics_table(spark, planted={("S1", "donor", "1")})
    s = scoring.score_pairs(m)
    segs = {(r.grp, r.start_iid, r.end_iid): r.score_mean for r in segment.segments(s).collect()}
    assert any(g == "1" and abs(a - 50) <= 2 and abs(b - 90) <= 2 and v > 0.5 for (g, a, b), v in segs.items())
    assert [k for k, v in segs.items() if k[0] == "2" and v > 0.3] == []


def test_donor_ties_take_the_first_component(spark):
    rows = [("S", "1", 0, "donor", c, 2.0, 0.5, None, None) for c in ("B", "A")] + [("S", "1", 0, "recipient", "R", 2.0, 0.5, None, None)]
    m = spark.createDataFrame(rows, "sample string, grp string, iid long, role string, component string, copy_number double, lambda_breadth double, gc double, mapq_high_fraction double").withColumn("lambda_count", F.col("lambda_breadth"))
    assert scoring.score_pairs(m).first().donor_component == "A"


def test_median_polish_takes_row_and_column_effects_away(spark):
    rows = [(i, f"s{j}", float(i * 3 + j * 7)) for i in range(6) for j in range(5)]
    got = robust.median_polish(spark.createDataFrame(rows, "i int, s string, v double"), ["i"], "s", "v")
    assert max(abs(r.v) for r in got.collect()) < 1e-9


def test_median_polish_equals_sweeps(spark):
    """Missing cells, repeated cells, a NULL row and a NULL column: the same residuals as sweep after sweep; other columns stay."""
    rng = np.random.default_rng(5)
    rows = [(i, f"s{j}", float(rng.normal() + i + 2 * j) if j < 6 and i != 3 and (i + j) % 7 else None, i * 10 + j) for i in range(12) for j in range(7) if (i, j) != (0, 0)]
    rows.append((1, "s1", 4.5, 999))
    want = spark.createDataFrame(rows, "i int, s string, v double, tag int")
    got = {r.tag: r.v for r in robust.median_polish(want, ["i"], "s", "v", max_sweeps=4, tol=0.0).collect()}
    for _ in range(4):
        want = spark.createDataFrame(robust.polish_sweep(want, ["i"], "s", "v").select("i", "s", "v", "tag").collect(), want.schema)
    want = {r.tag: r.v for r in want.select("tag", "v").collect()}
    assert want.keys() == got.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


def test_bins_without_a_null_borrow_the_whole_mode(spark):
    """Sparse and empty bins have the q99 of all calls, those without a bin too; a null of few values has the normal quantile in single mode only."""
    rng = np.random.default_rng(7)
    low = [("s", 7_000_000, float(v)) for v in rng.normal(0, 0.1, 30)] + [("s", 15_000_000, 1.0)] * 2 + [("s", 1_000_000, float(v)) for v in rng.normal(0, 0.1, 30)]
    high = [("s", 60_000_000, v) for v in (0.0, 0.8, 0.9, 1.0, 1.1)]
    calls = spark.createDataFrame(low + high, "sample string, width_bp long, score_mean double")
    x = np.array([v for *_, v in low + high])
    fit = robust.two_normals(x, np.ones(len(x)))
    null = x[x < 0.5]
    for mode in ("multi", "single"):
        got = {r.bin: r for r in calibrate.calibration(calls, Params(), mode).collect()}
        assert [got[k].n_control for k in range(5)] == [30, 2, 0, 5, 0] and fit["mu1"] > 0.7
        assert all(abs(got[k].q99 - np.quantile(null, 0.99)) < 1e-9 for k in (1, 2, 4))
        assert (abs(got[3].q99 - np.quantile(null, 0.99)) < 1e-9) == (mode == "multi") and got[3].q99 is not None


def test_mixture_of_many_values_takes_bins(spark):
    """20,000 distinct values make one row a bin, and the mixture agrees with that of the values."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, 15_000), rng.normal(1, 0.2, 5_000)])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    got, want = robust.mixtures(df, ["g"], "x").first(), robust.two_normals(x, np.ones(len(x)))
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_gc_residual_removes_a_curve():
    x = np.linspace(0.3, 0.6, 300)
    y = 3 * (x - 0.45) ** 2
    assert np.abs(robust.gc_residual(y, x)).max() < 0.02
    assert np.allclose(robust.gc_residual(np.arange(5.0), np.arange(5.0)), np.arange(5.0) - 2)


def test_mixture_and_mask(spark):
    m = robust.two_normals(np.array([0.0, 0.05, 0.8, 0.9]), np.array([50.0, 40.0, 10.0, 5.0]))
    assert m["mu0"] < 0.1 < 0.7 < m["mu1"]
    rows = [(f"s{k}", "1", i, 2.0 if 10 <= i < 14 else 0.0) for k in range(12) for i in range(100)]
    scores = spark.createDataFrame(rows, "sample string, grp string, iid long, score_raw double").withColumn("score", F.col("score_raw"))
    grid = spark.createDataFrame([("1", i, "donor", f"d{k}") for i in range(100) for k in range(2)], "grp string, iid long, role string, chr_id string")
    got = mask.recurrence_mask(scores, grid)
    with pytest.raises(Exception, match="no scores of window"):
        mask.recurrence_mask(scores, grid.unionByName(spark.createDataFrame([("2", 0, "donor", "d")], grid.schema))).collect()
    assert got.count() == 100  # each window once, whatever the number of donor contigs
    assert sorted(r.iid for r in got.filter("mask").collect()) == [10, 11, 12, 13]
    assert mask.apply_mask(scores, got).filter("score is null").count() == 48


def test_calibration_regimes(spark):
    calls = spark.createDataFrame([("s", float(i) / 100, 7_000_000) for i in range(100)] + [("s", 9.0, 1_000)], "sample string, score_mean double, width_bp long")
    controls = spark.createDataFrame([("s",)], "sample string")
    t = {r.bin: r for r in calibrate.calibration(calls, Params(), "multi", controls).collect()}
    v = np.arange(100) / 100
    kept = v[v <= np.quantile(v, 0.95)]
    assert abs(t[0].q99 - np.quantile(kept, 0.99)) < 1e-9 and t[0].n_control == 100
    assert t[1].threshold == 0.25 and t[1].q99 is None
    p = calibrate.passing(calls, calibrate.calibration(calls, Params(), "multi", controls), Params(), "multi")
    assert p.filter("width_bp = 1000 and pass").count() == 0


def test_classes(spark):
    rows = [(1.2, -0.7, 0.0, True), (1.2, 0.0, 0.1, True), (0.0, -1.2, -1.2, True), (1.2, -0.7, 0.9, True), (1.2, 0.9, 0.0, True), (0.0, 0.0, 0.0, True), (1.2, 0.0, 0.1, False)]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 0.9) for r in rows], "donor_residual double, recipient_residual double, total_residual double, pass boolean, donor_spread double, supported_donors double, mapq_high_fraction double")
    got = [(r["class"], r.class_status) for r in classify.classify(df).collect()]
    assert got == [("substitution", "confident"), ("addition", "confident"), ("deletion", "confident"), ("complex", "needs_review"), ("complex", "needs_review"), ("other", "needs_review"), ("addition", "needs_review")]


def test_registry(spark):
    header = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, length long")
    reg = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "b", 2), ("y", "c", 3), ("z", "c", 4)], "assembly string, id string, length long")
    m = registry.header_match(header, reg)
    assert registry.most_specific(m).first().assembly == "y"
    contigs = reg.withColumnRenamed("assembly", "species").filter("species <> 'y'")
    assert {(r.recipient, r.donor): r.n_matched for r in registry.species_pairs(header, contigs).collect()} == {("x", "z"): 2, ("z", "x"): 2}


def test_sam_text_and_headers(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c:1\tLN:100\n@RG\tID:g\tSM:S\nq\t0\tc:1\t6\t60\t10M\t*\t0\t0\t*\t*\tRG:Z:g\r\n")
    lines = readers.sam_lines(spark, str(tmp_path))
    r = readers.alignments(lines).first()
    assert (r.pos, r.mapq, r.rg, r.cigar) == (5, 60, "g", "10M")
    assert readers.header_targets(lines).first().name == "c:1"
    assert readers.read_groups(lines).first().sample == "S" and readers.sort_order(lines).first().sort_order == "coordinate"


def test_fasta_offsets(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">d1 x\nACGT\nGG\n>d2\nTTTTT\n")
    got = sorted(tuple(r) for r in readers.fasta(spark, str(tmp_path)).collect())
    assert got == [("d1", 0, "ACGT"), ("d1", 4, "GG"), ("d2", 0, "TTTTT")]


def test_fasta_files_of_several_splits(spark, tmp_path):
    """Files whose splits are mixed by size when Spark packs them, each contig over several splits, lines of every length."""
    rng = random.Random(5)
    want = {}
    for k, (contigs, lines) in enumerate([(3, 40), (2, 33), (1, 25)]):
        text = []
        for c in range(contigs):
            seq = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))) for _ in range(lines)]
            want[f"f{k}c{c}"] = "".join(seq)
            text += [f">f{k}c{c} text", *seq]
        (tmp_path / f"{k}.fa").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    try:
        got = {}
        for r in readers.fasta(spark, str(tmp_path)).orderBy("chr_id", "offset").collect():
            assert r.offset == len(got.get(r.chr_id, ""))
            got[r.chr_id] = got.get(r.chr_id, "") + r.bases
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_fasta_lines_are_not_sorted(spark, tmp_path):
    rng = random.Random(5)
    made = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 59, 60, 61, 700]))) for i in range(60)}
    (tmp_path / "a.fa").write_text("".join(f">{k} note\n" + "".join(f"{v[i : i + 60]} \n" for i in range(0, len(v), 60)) for k, v in made.items()))
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = readers.fasta(spark, str(tmp_path))
        got = {}
        for r in out.orderBy("chr_id", "offset").collect():
            assert r.offset == len(got.get(r.chr_id, ""))
            got[r.chr_id] = got.get(r.chr_id, "") + r.bases
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {k: v for k, v in made.items() if v}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_size" in plan and "sum(_size" not in plan  # running sums over the lines sorted each split in a task


def test_contigs_of_sorted_files_are_found_by_bisection(spark, tmp_path):
    """A filter on contigs opens only their bytes in sorted files, everything in others, and never changes the lines."""
    rng = random.Random(3)
    line = lambda q, c, p: f"q{q}\t0\t{c}\t{p}\t60\t10M\t*\t0\t0\t{'A' * rng.randint(0, 90)}\t*"
    names = ["c9", "c1", "c5", "c3", "none"]
    rows = [line(q, c, rng.randint(1, 999)) for q, c in enumerate(["c9"] * 40 + ["c1"] * 3 + ["c5"] * 70 + ["c3"] * 50 + ["*"] * 9)]
    head = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:1000" for n in names)]
    (tmp_path / "sorted a.sam").write_text("\n".join(head + rows))
    mixed = rows[:]
    rng.shuffle(mixed)
    (tmp_path / "mixed.sam").write_text("\r\n".join(head[1:] + mixed) + "\r\n")
    (tmp_path / "empty.sam").write_text("")
    (tmp_path / "headers.sam").write_text("\n".join(head))
    every = sorted((r.rname, r.value) for r in ranges.on_contigs(spark, str(tmp_path), 150).collect())
    assert every == sorted((x.split("\t")[2], x) for x in rows * 2)
    whole = ranges.on_contigs(spark, str(tmp_path / "sorted a.sam"), 150)
    n = whole.rdd.getNumPartitions()
    for wanted in (["c1"], ["c9"], ["c3", "c1"], ["none"], ["unknown"], ["*"], names):
        df = ranges.on_contigs(spark, str(tmp_path), 150).filter(F.col("rname").isin(*wanted))
        assert sorted((r.rname, r.value) for r in df.collect()) == [x for x in every if x[0] in wanted]
        one = whole.filter(F.col("rname").isin(*wanted))
        size = sum(len(x) + 1 for x in rows if x.split("\t")[2] in wanted)
        if set(wanted) < set(names):
            assert one.rdd.getNumPartitions() <= size // 150 + 1 + len(wanted) < n
    both = whole.filter("rname = 'c5' and value like 'q50%'")
    assert [r.rname for r in both.collect()] == ["c5"] and both.rdd.getNumPartitions() < n
    keys = {r.path for r in readers.sam_lines(spark, str(tmp_path)).filter("value not like '@%'").select("path").distinct().collect()}
    assert keys == {r.path for r in ranges.on_contigs(spark, str(tmp_path)).select("path").distinct().collect()}


def test_written_alignments_are_sorted_and_read_again(spark, tmp_path):
    rows = [(f"q{i}\t0\t{c}\t{i * 37 % 101 + 1}\t60\t5M\t*\t0\t0\t*\t*",) for i, c in enumerate(["b", "a", "x", "b"] * 30)]
    targets = spark.createDataFrame([("b", 200, 0), ("a", 200, 1)], "name string, length int, ord int")
    writers.write_alignments(spark.createDataFrame(rows, "value string"), targets, str(tmp_path / "s"))
    for f in (tmp_path / "s").glob("part-*"):
        lines = [x.split("\t") for x in f.read_text().splitlines()]
        assert [x[0] for x in lines[:3]] == ["@HD", "@SQ", "@SQ"]
        at = [("bax".index(x[2]), int(x[3])) for x in lines[3:]]
        assert at == sorted(at)
    got = ranges.on_contigs(spark, str(tmp_path / "s")).filter("rname = 'a'")
    assert sorted(r.value for r in got.collect()) == sorted(v for (v,) in rows if v.split("\t")[2] == "a")


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("a b",), ("A-B",), ("run",), ("..",)], "sample string")
    got = {r.sample: r.folder for r in writers.sample_folders(s).collect()}
    assert len({v.lower() for v in got.values()}) == 4 and got["run"] != "run"
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert writers.manifest(spark, str(tmp_path)).filter("path like '%.parquet'").count() > 0


def test_manifest_of_large_files(spark, tmp_path):
    """A file of over 2 GB (without blocks on disk), an empty one and a name with blanks and per cent have their digests."""
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.truncate((1 << 31) + 5)
    (tmp_path / "a b%20c.txt").write_bytes(b"text")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.md5) for r in writers.manifest(spark, str(tmp_path)).collect()}
    zeros = hashlib.md5()
    for k in [1 << 24] * 128 + [5]:
        zeros.update(bytes(k))
    assert got == {"big.bin": ((1 << 31) + 5, zeros.hexdigest()), "a b%20c.txt": (4, hashlib.md5(b"text").hexdigest()), "empty": (0, hashlib.md5(b"").hexdigest())}


def test_parameters(spark):
    assert params.resolve("balanced", {"fdr": 0.02}, {"fdr": 0.05}).fdr == 0.05
    assert params.stretch((1.0, 3.0), 3) == (1.0, 2.0, 3.0)
    for bad in ({"nope": 1}, {"fdr": 2.0}):
        with pytest.raises(ValueError):
            params.resolve("balanced", None, bad)
    with pytest.raises(ValueError, match="unknown profile"):
        params.resolve("nope")
    assert {r.parameter for r in params.changed(spark, params.resolve("sensitive")).collect()} == {"windows", "metric", "floors_single"}
    flat = {(r.profile, r.parameter): (r.value, r.is_default) for r in params.profiles(spark).collect()}
    assert flat["cnv_robust", "score_type"] == ("donor", False) and flat["complex", "windows"] == ("1000", True) and flat["balanced", "merge_gap"] == ("100", True)


def test_schema_of_empty_and_filled_tables_agree(spark):
    filled = schemas.conform(spark.createDataFrame([("s", 1)], "sample string, start_iid int"), schemas.CALLS, {"pass": False})
    assert filled.schema.names == schemas.empty(spark, schemas.CALLS).schema.names and filled.first()["pass"] is False
    with pytest.raises(ValueError, match="calls"):
        schemas.validate({})


def test_explorer_filters(spark):
    c = spark.createDataFrame([("1", "2", "cross_group", True, "addition"), ("1", None, "assigned", None, "addition"), ("3", None, "no_recipient_loss", True, "other")], "grp string, recipient_group string, recipient_assignment string, pass boolean, class string")
    assert explore.explorer_filter(c, groups=["2"]).count() == 1
    assert explore.explorer_filter(c, pass_only=True).count() == 2
    assert explore.explorer_filter(c, show_unplaced=False).count() == 2


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("A2",), (None,), ("a1",)], "x string")
    assert [r.x for r in df.orderBy(*fn.natural_order("x")).collect()] == ["a1", "A2", "a10", None]


def test_every_rule_of_classes(spark):
    # donor, recipient, total, pass -> class, evidence, copy_state, confidence, status, effect; by the published rules, by hand
    cases = [
        ((1.2, -0.7, 0.0, True), ("substitution", "donor+recipient", "balanced", "high", "confident", "high")),
        ((0.7, -0.7, None, True), ("substitution", "donor+recipient", "balanced", "moderate", "ambiguous", "moderate")),
        ((1.2, -0.7, 0.9, True), ("complex", "donor+recipient; total imbalance", "compound", "moderate", "needs_review", "high")),
        ((1.2, 0.0, 0.8, True), ("addition", "donor", "gain", "high", "confident", "high")),
        ((1.2, 0.0, -0.2, True), ("addition", "donor", "gain", "moderate", "ambiguous", "high")),
        ((1.2, 0.0, -0.8, True), ("complex", "total imbalance", "compound", "moderate", "needs_review", "high")),
        ((1.2, 0.0, 0.1, False), ("addition", "donor", "gain", "moderate", "needs_review", "moderate")),
        ((0.0, -1.2, -1.2, True), ("deletion", "recipient", "loss", "high", "confident", "low")),
        ((0.0, -0.7, -0.7, True), ("deletion", "recipient", "loss", "moderate", "ambiguous", "low")),
        ((0.0, -0.7, 0.7, True), ("complex", "total imbalance", "compound", "moderate", "needs_review", "low")),
        ((1.2, 0.9, 0.0, True), ("complex", "total imbalance", "compound", "moderate", "needs_review", "high")),
        ((0.0, 0.9, 0.7, False), ("other", "recipient", "gain", "low", "ambiguous", "low")),
        ((0.0, 0.0, -0.7, True), ("other", "none", "loss", "low", "ambiguous", "low")),
        ((0.0, 0.0, 0.0, True), ("other", "none", "neutral", "low", "needs_review", "low")),
        ((1.2, None, 0.0, True), ("addition", "donor", "gain", "low", "needs_review", "high")),
    ]
    df = spark.createDataFrame([(i, *c, 0.0, 0.0, 1.0, 0.9) for i, (c, _) in enumerate(cases)], "i int, donor_residual double, recipient_residual double, total_residual double, pass boolean, donor_spread double, recipient_spread double, supported_donors double, mapq_high_fraction double")
    got = {r.i: (r["class"], r.evidence, r.copy_state, r.class_confidence, r.class_status, r.confidence) for r in classify.classify(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    mixed = classify.classify(df.filter("i = 0").withColumn("recipient_spread", F.lit(2.5))).first()
    assert (mixed.component_status, mixed.class_confidence, mixed.class_status) == ("heterogeneous", "moderate", "ambiguous")


def test_cutoffs_nest_and_shrink(spark):
    rows = [("c", "multi", 0, 0.1 * k, -0.05 * k, (-1) ** k * 0.2 * k) for k in range(20)] + [("c", "multi", 1, 3.0, -3.0, 4.0)] * 4 + [("x", "multi", 1, 9.0, -9.0, 9.0), ("x", "multi", None, 9.0, -9.0, 9.0)]
    calls = spark.createDataFrame(rows, "sample string, mode string, bin int, donor_residual double, recipient_residual double, total_residual double")
    got = {r.bin: r for r in calibrate.cutoffs(calls, Params(), spark.createDataFrame([("c",)], "sample string")).collect()}
    own = np.arange(20) * 0.1
    whole = np.append(own, [3.0] * 4)
    w = 20 / 40
    assert abs(got[0].donor_mod - max(0.5, w * np.quantile(own, 0.95) + (1 - w) * np.quantile(whole, 0.95))) < 1e-9
    assert got[1].n_control == 0 and abs(got[1].donor_mod - np.quantile(whole, 0.95)) < 1e-9 and got[-1].donor_mod == got[1].donor_mod  # under five values: the mode's
    assert all(r.donor_high >= r.donor_mod and r.total_high >= r.total_mod and r.loss_high <= r.loss_mod for r in got.values())
    assert {r.total_mod for r in calibrate.cutoffs(calls, Params(), spark.createDataFrame([("nobody",)], "sample string")).collect()} == {0.5}


def test_interval_stats_by_hand(spark):
    rng = np.random.default_rng(8)
    series = {"a": np.cumsum(rng.normal(size=40)), "b": np.array([2.0]), "c": np.array([1.0, 2.0, 4.0]), "d": np.full(6, 3.0)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    got = {r.k: r for r in assign.interval_stats(spark.createDataFrame(rows, "k string, iid int, depletion double"), ["k"]).collect()}
    for k, x in series.items():
        n, d = len(x), x - x.mean()
        rho = sum((d[j:] * d[:-j]).sum() / (d * d).sum() for j in range(1, min(10, n - 1) + 1)) if n >= 4 and x.std() > 0 else 0
        n_eff = min(max(n / max(1, 1 + 2 * rho), 1), n) if n >= 4 and x.std() > 0 else n
        se = x.std(ddof=1) / math.sqrt(n_eff) if n > 1 else 0
        assert abs(got[k].n_eff - n_eff) < 1e-9 and abs(got[k].lower - (x.mean() - 1.645 * se)) < 1e-9
    assert got["d"].z is None and got["a"].n_eff < 40


def test_prefix_moments_equal_interval_stats(spark):
    """Every interval of profiles with gaps, equal stretches and one value: the same statistics from two rows as from all windows."""
    rng = np.random.default_rng(4)
    series = {"walk": np.cumsum(rng.normal(size=30)) + 1e3, "flat": np.full(18, -13.8), "steps": np.repeat([1.0, 2.0, -4.0], 6), "one": np.array([2.5])}
    rows = [(k, i, None if k != "one" and i % 5 == 2 else float(v), None if i % 4 == 0 else float(i)) for k, x in series.items() for i, v in enumerate(x)]
    profile = spark.createDataFrame(rows, "k string, iid int, v double, m double")
    spans = spark.createDataFrame([(f"{k}{a}-{b}", k, a, b) for k, x in series.items() for a in range(len(x)) for b in range(a, len(x), 3)], "id string, k string, a int, b int")
    sums = assign.prefix_moments(profile, ["k"], "v", ("m",)).persist()
    ends = spans.join(sums.select("k", F.col("iid").alias("a"), "_first"), ["k", "a"]).join(sums.select("k", F.col("iid").alias("b"), "_last"), ["k", "b"])
    got = {r.id: r for r in assign.interval_moments(ends, ("m",)).collect()}
    inside = spans.join(profile, "k").filter("iid between a and b and v is not null")
    want = {r.id: r for r in assign.interval_stats(inside, ["id"], "v").collect()}
    means = {r.id: r.m for r in inside.groupBy("id").agg(F.avg("m").alias("m")).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    for k, w in want.items():
        g = got[k]
        assert g.n == w.n and g.m == means[k]
        if w.n > 1 and abs(w.se) < 1e-9:
            assert g.se == 0 and g.z is None and abs(g.mean - w.mean) < 1e-9
        else:
            assert all(math.isclose(g[c], w[c], rel_tol=1e-6, abs_tol=1e-6) for c in ("mean", "se", "lower", "n_eff")), (k, g, w)


def test_hosts_of_planted_calls(spark):
    """A deletion finds the contig that lacks coverage; two calls share no host; an addition without loss has none; a second run changes nothing."""
    n = 100
    rows = []
    for s in ("S1", "S2", "S3", "S4", "S5"):
        for g in ("1", "2"):
            for i in range(n):
                gone = s == "S1" and ((g == "1" and 20 <= i < 40) or (g == "2" and 60 <= i < 80))
                lam = 0.001 if gone else 0.5 * (1 + 0.02 * ((i * 7 + len(s) + int(g)) % 5))
                rows.append((s, f"r{g}", g, "recipient", i, i * 1000, (i + 1) * 1000, 0.4, lam, 1 - math.exp(-lam), 0.9))
    m = spark.createDataFrame(rows, "sample string, chr_id string, grp string, role string, iid long, start long, stop long, gc double, lambda_breadth double, breadth double, mapq_high_fraction double")
    res = assign.recipient_residuals(m)
    assert res.filter("sample = 'S1' and grp = '1' and iid = 30").first().depletion > 4
    calls = [("a", "S1", "1", 20, 39, 1.5, -3.0, 0.0), ("b", "S1", "1", 60, 79, 0.0, -3.0, -1.5), ("c", "S1", "2", 10, 19, 1.2, 0.0, 0.8)]
    c = spark.createDataFrame([(i, s, g, "multi", 1, a, b, a * 1000, (b + 1) * 1000, (b + 1 - a) * 1000, n * 1000, d, r, t, True, 0.0, 0.0, 1.0, 0.9) for i, s, g, a, b, d, r, t in calls], "call_id string, sample string, grp string, mode string, bin int, start_iid long, end_iid long, start_bp long, end_bp long, width_bp long, donor_length long, donor_residual double, recipient_residual double, total_residual double, pass boolean, donor_spread double, recipient_spread double, supported_donors double, mapq_high_fraction double")
    c = classify.classify(c)
    cuts = calibrate.cutoffs(c, Params())
    out = assign.assign_hosts(c, res, n, Params(), None, cuts).persist()
    got = {r.call_id: r for r in out.collect()}
    assert (got["a"].recipient_chr, got["a"].recipient_assignment, got["a"]["class"], got["a"].class_status) == ("r1", "assigned", "substitution", "confident")
    assert (got["b"].recipient_chr, got["b"].recipient_assignment, got["b"].class_status, got["b"].recipient_cross_group) == ("r2", "cross_group", "needs_review", True)
    assert got["c"].recipient_assignment == "no_recipient_loss" and got["c"].assignment_weight == 0 and got["c"]["class"] == "addition"
    assert (got["a"].recipient_start_iid, got["a"].recipient_end_iid, got["a"].recipient_start_bp, got["a"].recipient_end_bp) == (20, 39, 20_000, 40_000)
    with pytest.raises(Exception, match="windows are missing"):
        assign.candidates(assign.with_thresholds(c), res.filter("iid <> 20"), n).collect()
    again = {r.call_id: r.asDict() for r in assign.assign_hosts(out, res, n, Params(), None, cuts).collect()}
    assert all(again[k]["class"] == got[k]["class"] and again[k]["recipient_chr"] == got[k].recipient_chr for k in got)


def test_masked_segments_and_long_profiles():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.3, 1500)
    x[400:700] += 1.0
    cuts = segment.segment_profile(x)
    assert any(abs(a - 400) <= 5 and abs(b - 699) <= 5 for a, b, _ in cuts) and len(cuts) <= 5
    assert len(segment.segment_profile(rng.normal(0, 0.3, 1500))) == 1
    rows = rng.normal(size=(3, 60))
    ends = [0, *range(5, 56), 60]
    arcs = [(i, j) for i in ends for j in ends if j - i >= 5 and (i, j) != (0, 60)]
    for longest in (60, 12):
        best = [max((r[i:j].sum() - r.mean() * (j - i)) ** 2 * 60 / ((j - i) * (60 - j + i)) for i, j in arcs if min(j - i, 60 - j + i) <= longest) for r in rows]
        assert np.allclose(segment._peaks(rows, 5, longest), best)
    assert np.isclose(segment._best_arc(rows[0], 5)[0], segment._peaks(rows[:1], 5, 60)[0])


@pytest.mark.parametrize("n", [100, 200, 201, 1000])
def test_noise_is_split_as_often_as_alpha_says(n):
    rng, alpha, trials = np.random.default_rng(3), 0.05, 200
    hits = sum(bool(segment._split(rng.standard_normal(n), alpha, 5, np.random.default_rng(r))) for r in range(trials))
    assert abs(hits / trials - alpha) <= 2 * math.sqrt(alpha * (1 - alpha) / trials)


def test_boundary_ends_few_tests_wrongly():
    ends, rng = segment.boundary(10, 2000, 0.05), np.random.default_rng(2)
    assert list(ends) == sorted(ends) and ends[0] < 1000
    early = sum(any(t > m for t, m in zip(np.sort(rng.choice(2000, 11, replace=False)) + 1, ends, strict=True)) for _ in range(4000))
    assert early / 4000 <= 0.05


def test_single_event_is_found_within_a_few_windows():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 0.05, 200)
        x[50:91] += 1.5
        assert [(a, b) for a, b, m in segment.segment_profile(x, seed=seed) if m > 1] == [(50, 90)]
        x[120] += 30  # one outlier is drawn in, not a segment
        got = segment.segment_profile(x, seed=seed)
        assert len(got) == 3 and got[2][2] < 0.1


def test_profiles_are_resampled(spark):
    profile = spark.createDataFrame([(g, i, float(i)) for g in "ab" for i in range(10)], "g string, iid long, score double")
    cuts = spark.createDataFrame([("a", 0.2, 0.5), ("a", 0.4, 0.6)], "g string, start double, stop double")
    got = {}
    for r in intervals.resampled(profile, cuts, ["g"], 10).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append(r.score)
    assert got == {"a": [0.0, 1.0, 6.0, 7.0, 8.0, 9.0], "b": [float(i) for i in range(10)]}


def test_ingest_refuses_what_does_not_fit(spark):
    reads_ = spark.createDataFrame([("c", 1)], "rname string, pos long")
    ok = spark.createDataFrame([("c", 10)], "id string, length long")
    assert readers.checked_alignments(reads_, ok, ok.withColumnRenamed("id", "name")).count() == 1
    with pytest.raises(Exception, match="differs from the header"):
        readers.checked_alignments(reads_, ok, spark.createDataFrame([("c", 11)], "name string, length long")).collect()
    with pytest.raises(Exception, match="no source of contig"):
        tiling.route(ok, spark.createDataFrame([("x", "l")], "name string, list string")).collect()
    with pytest.raises(Exception, match="no base composition"):
        metrics.window_metrics(spark.createDataFrame([("s", "c", 0, 1, 1, 1)], "sample string, chr_id string, iid long, count long, mapq_high long, covered long"), spark.createDataFrame([("c", 0, 0, 5)], "chr_id string, iid long, start long, stop long"), spark.createDataFrame([], "chr_id string, iid long, gc double")).collect()


def test_contig_lists_keep_their_order(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\t10\t0\ny\t5\t10\n")
    (tmp_path / "b.tsv").write_text("y\t5\t10\nx\t10\t0\n")
    bad = tiling.offset_violations(readers.contig_list(spark, str(tmp_path))).collect()
    assert {(r.list.split("/")[-1], r.rule, r.key) for r in bad} == {("b.tsv", "offset", "y"), ("b.tsv", "offset", "x")}


def test_exports(spark, tmp_path):
    assert len(writers.BEDPE_COLUMNS) == 48 and len(writers.BEDPE.names) == 48
    t = spark.createDataFrame([("a", 1), ("A", 2), ("a-2", 3)], "sample string, v int")
    writers.write_by_sample({"t": t}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len({r.folder.lower() for r in back}) == 3
    d = {r.column: r.export_name for r in writers.dictionary(spark.createDataFrame([], schemas.MASKS), writers.QC_NAMES["masks"]).collect()}
    assert d["f"] == "mask_signal" and writers.extra_columns(t, ["v"]) == []
    rows = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 0)], "sample string, chr_id string, iid long")
    place = spark.createDataFrame([("b", 1), ("a", 2)], "chr_id string, ord int")
    assert [(r.chr_id, r.iid) for r in schemas.ordered(rows, "metrics", place).collect()] == [("b", 0), ("b", 1), ("a", 2)]


def test_hidden_deletions_are_spliced(spark):
    scores = spark.createDataFrame([("s", "g", i, float(i)) for i in range(10)], "sample string, grp string, iid long, score double")
    calls = spark.createDataFrame([("s", "g", 2, 3, "deletion", "x", True, 1.0), ("s", "g", 6, 7, "addition", "x", True, 1.0)], "sample string, grp string, start_iid long, end_iid long, class string, class_status string, pass boolean, score_mean double")
    hidden = spark.createDataFrame([("s", "g", 0.2, 0.4)], "sample string, grp string, start double, stop double")
    r = payload.records(scores, calls, 10, hidden).first()
    assert r.scores == [0.0, 1.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    assert [(c["class"], round(c["from"], 9), round(c["to"], 9)) for c in r.calls] == [("addition", 0.5, 0.75)]


def test_deep_windows_and_long_ranges(spark):
    rng = random.Random(12)
    rows = [("k" if rng.random() < 0.7 else "l", a := rng.randrange(200), a + rng.randrange(0, 40)) for _ in range(3000)]
    got = {r.k: r.covered for r in reads.union_length(spark.createDataFrame(rows, "k string, clip_start long, clip_stop long"), ["k"]).collect()}
    assert got == {k: len({x for key, a, b in rows if key == k for x in range(a, b)}) for k in "kl"}
    points = [(c, p) for c in "ab" for p in [0, 1, 127, 128, 16383, 16384, 10**9, 2**41] for _ in range(rng.randint(1, 3))] + [("a", rng.randrange(10**6)) for _ in range(500)]
    ranges = [(i, rng.choice("abc"), rng.choice([0, 1, 128, 5, 16384, 10**9, 2**41, rng.randrange(10**6)]), rng.choice([0, 2, 129, 10**6, 10**9 + 1, 2**41 + 1, 2**42, rng.randrange(10**6)])) for i in range(300)]
    got = {r.range_id: r.n for r in reads.count_ranges(spark.createDataFrame(points, "chr_id string, pos long"), spark.createDataFrame(ranges, "range_id long, chr_id string, start long, stop long")).collect()}
    assert got == {i: sum(a <= p < b for k, p in points if k == c) for i, c, a, b in ranges}


def test_counts_do_not_depend_on_slices(spark):
    """Deep and shallow windows, reads of several blocks, repeated rows: every number of slices says what sets of bases and names say."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        window = 0 if rng.random() < 0.5 else rng.randint(1, 9)
        a = window * 100 + rng.randint(0, 90)
        rows += [("s", "c", window, f"r{i % 700}", i % 700 % 60, a, a + rng.randint(1, 100 - a % 100), i)] * rng.choice([1, 1, 2])
    want = {}
    for _, _, w, read, q, a, b, v in rows:
        x = want.setdefault(w, (set(), set(), set(), []))
        x[0].add(read), x[1].update([read] if q >= 30 else []), x[2].update(range(a, b)), x[3].append(v)
    want = {w: (len(a), len(b), len(c), sum(d)) for w, (a, b, c, d) in want.items()}
    df = spark.createDataFrame(rows, "sample string, chr_id string, iid long, read string, mapq int, clip_start long, clip_stop long, v long")
    for slices in (1, 3, 64):
        got = {r.iid: (r["count"], r.mapq_high, r.covered, r.v) for r in reads.count_windows(df, sums={"v": F.col("v")}, slices=slices).collect()}
        assert got == want


def test_windows_are_counted_without_sorts(spark):
    """Intervals at the borders of stretches and over many of them; a read's quality in a window is its best; samples and contigs without names stay apart."""
    spans = [(0, 1), (63, 64), (63, 65), (255, 257), (256, 512), (300, 310), (305, 320), (1000, 9_000), (8_990, 9_001), (1 << 40, (1 << 40) + 64)]
    rows = [("S", "c", 0, f"r{i}", 10, a, b) for i, (a, b) in enumerate(spans)] + [("S", "c", 0, "r0", 60, 5, 6), (None, "c", 0, "r0", 30, 5, 6), ("S", None, 0, "r0", 29, 5, 7), (None, "c", 1, "r0", None, 5, 8), ("c", None, 1, "r0", 30, 5, 9)]
    df = spark.createDataFrame(rows, "sample string, chr_id string, iid long, read string, mapq int, clip_start long, clip_stop long")
    out = reads.count_windows(df)
    bases = set().union(*(range(a, b) for a, b in spans), {5})
    assert {tuple(r) for r in out.collect()} == {("S", "c", 0, len(spans), 1, len(bases)), (None, "c", 0, 1, 1, 1), ("S", None, 0, 1, 0, 2), (None, "c", 1, 1, 0, 3), ("c", None, 1, 1, 1, 4)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # sorted every piece twice, and once more for each window


def test_windows_are_counted_from_a_narrow_table(spark):
    """Pieces are made once, reads move without names of samples and contigs, and bases don't move as rows of reads."""
    rows = [("S", "c", i % 3, f"r{i % 50}", i, i % 3 * 1000 + i, i % 3 * 1000 + i + 300) for i in range(200)]
    df = spark.createDataFrame(rows, "sample string, chr_id string, iid long, name string, mapq int, clip_start long, clip_stop long").withColumn("read", F.regexp_replace("name", "r", "q"))
    out = reads.count_windows(df, sums={"v": F.col("mapq")})
    want = {}
    for _, _, w, name, q, a, b in rows:
        x = want.setdefault(w, ({}, set(), []))
        x[0][name] = max(q, x[0].get(name, 0))
        x[1].update(range(a, b)), x[2].append(q)
    assert {r.iid: (r["count"], r.mapq_high, r.covered, r.v) for r in out.collect()} == {w: (len(a), sum(q >= 30 for q in a.values()), len(b), sum(c)) for w, (a, b, c) in want.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" not in plan  # rows of reads and of bases were one wide grouping over the pieces' own plan
    by_read = [line.split("], [")[0] for line in plan.splitlines() if "Aggregate [" in line and "_read#" in line.split("], [")[0]]
    assert by_read and not any(c in line for line in by_read for c in ("sample#", "chr_id#", "_m0#"))


def test_reads_of_lines_are_told_apart_as_their_names(spark, sf, tmp_path):
    """Keys made of numbers count whole repeated lines once and names that leave out different NULLs as one, as the names do."""
    for t in ("orders", "customer", "supplier", "nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey < 40")
    one = li.limit(1).withColumns({"l_linenumber": F.lit(None).cast("int"), "l_partkey": F.lit(7).cast("long")})
    odd = one.unionByName(one.withColumns({"l_linenumber": F.lit(7), "l_partkey": F.lit(None).cast("long")}))
    li.unionByName(li.filter("l_linenumber = 1")).unionByName(odd).select(*spark.read.parquet(f"{sf}/lineitem.parquet").columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    i = mp.intervals_of(spark, str(tmp_path))
    a = i.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("read").alias("names"), F.count_distinct("read_key").alias("keys"), F.count_distinct("read", "read_key").alias("both")).first()
    assert a.n > a.names == a.keys == a.both


def test_run_coverage(spark):
    m = spark.createDataFrame([("a", 0), ("b", 2), ("c", None), ("b", 0)], "sample string, count long")
    assert tuple(metrics.run_coverage(m).first()) == (3, 2, "a")
    assert tuple(metrics.run_coverage(m.limit(0)).first()) == (0, 0, None)


def test_texts_of_missing_and_extreme_numbers(spark):
    rows = [(0.125, -1.5, 999, 1000), (None, None, None, 5), (float("nan"), 0.0, 7, None), (1.0, 2.0, None, None), (0.005, float("inf"), -1, 2_500_000)]
    df = spark.createDataFrame(rows, "f double, s double, a long, b long")
    got = [tuple(r) for r in df.select(fn.percent_text("f"), fn.signed_text("s"), fn.span_text("a", "b")).collect()]
    assert got == [("12%", "-1.50", "999 bp \u2013 1.0 kb"), ("NA", "NA", "to 5 bp"), ("NA", "0.00", "from 7 bp"), ("100%", "+2.00", ""), ("0%", "NA", "NA \u2013 2.5 Mb")]
    t = spark.sql("select timestamp'2024-05-01 12:30:00' as a, timestamp'2024-05-01 12:30:02.5' as b").select(fn.iso_text("a"), fn.seconds_between("a", "b")).first()
    assert tuple(t) == ("2024-05-01T12:30:00+0000", 2.5)


def test_header_lines_with_many_fields(spark):
    line = "@RG\tID:x\t" + "\t".join(f"K{i}:{i}" for i in range(12_000)) + "\tSM:last"
    assert readers.read_groups(spark.createDataFrame([("p.sam", line)], "path string, value string")).first().sample == "last"
