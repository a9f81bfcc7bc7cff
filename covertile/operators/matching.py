"""One-to-one matching of two kinds of things, component by component of the graph of what may go together."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covertile.plans.tables import saved

#: Steps of one unit of gain that the auction tells apart.
GRAIN = 1 << 20
SALTS = 64


def components(nodes: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` (keys, node) with ``component``: the smallest node reachable over ``pairs`` (keys, a, b), by keys.

    Labels take the smallest of their neighbours' and then their label's label, so the rounds grow with the logarithm of long paths.
    """
    both = saved(pairs.select(*keys, "a", "b").unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(nodes.select(*keys, "node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(label.select(*keys, F.col("node").alias("b"), F.col("component").alias("_n")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_n").alias("_n"))
        least = label.join(near, [*keys, "node"], "left").select(*keys, "node", F.least("component", "_n").alias("component"), F.col("component").alias("_was"))
        jump = label.select(*keys, F.col("node").alias("component"), F.col("component").alias("_up"))
        step = saved(least.join(jump, [*keys, "component"], "left").select(*keys, "node", F.least("component", "_up").alias("component"), "_was"))
        label = step.drop("_was")
        if step.filter("component <> _was").isEmpty():
            return label


def auction(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """left -> right of the matching with the largest sum of gains (to 1 / GRAIN); pairs without gain are left out, nobody has to be matched.

    Each left bids for the right that is worth most to it at present prices, by as much as it is better than the next one, and outbids
    the one before. The graph is doubled with sides changed, so that everyone has a partner (its own copy, for nothing) and prices can start
    from those of a coarser round.
    """
    edges = [(a, b, round(g * GRAIN)) for a, b, g in edges if g > 0]
    lefts, rights = sorted({a for a, _, _ in edges}), sorted({b for _, b, _ in edges})
    at_l, at_r = {a: i for i, a in enumerate(lefts)}, {b: i for i, b in enumerate(rights)}
    n, m = len(lefts), len(rights)
    scale = n + m + 1
    worth: list[list[tuple[int, int]]] = [[(m + i, 0)] for i in range(n)] + [[(j, 0)] for j in range(m)]
    top = 0
    for a, b, g in edges:
        i, j = at_l[a], at_r[b]
        worth[i].append((j, g * scale))
        worth[n + j].append((m + i, g * scale))
        top = max(top, g * scale)
    price = [0] * (n + m)
    owner: list[int] = []
    step = max(1, top // 4)
    while n:
        owner = [-1] * (n + m)
        waiting = deque(range(n + m))
        while waiting:
            i = waiting.popleft()
            best = second = at = None
            for j, g in worth[i]:
                v = g - price[j]
                if best is None or v > best:
                    best, second, at = v, best, j
                elif second is None or v > second:
                    second = v
            price[at] += best - second + step
            if owner[at] >= 0:
                waiting.append(owner[at])
            owner[at] = i
        if step == 1:
            break
        step = max(1, step // 5)
    return {lefts[owner[j]]: rights[j] for j in range(m) if 0 <= owner[j] < n} if n else {}


def best_matching(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, component): for each of ``keys`` the one-to-one matching of ``edges`` (keys, left, right, gain > 0) with the largest sum of gains.

    In a component with k rights, each right can be content with one of its k best lefts: were it matched to another, one of those would be free.
    So a component keeps k edges a right, at most k^2, whatever the number of lefts; salted, then whole windows cut the others. Each component is
    one auction.
    """
    parts = edge_components(edges, keys)
    size = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_k"))
    e = edges.filter("gain > 0").join(parts.join(size, [*keys, "component"]), [*keys, "right"]).withColumn("_salt", F.pmod(F.xxhash64("left"), F.lit(SALTS)))
    for by in ([*keys, "right", "_salt"], [*keys, "right"]):
        e = e.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gain"), "left"))).filter("_r <= _k")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    names = [*keys, "component"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        l_code, lefts = pd.factorize(pdf["left"], sort=True)
        r_code, rights = pd.factorize(pdf["right"], sort=True)
        got = auction(list(zip(l_code.tolist(), r_code.tolist(), pdf["gain"].tolist(), strict=True)))
        return pd.DataFrame([(*key, lefts[a], rights[b]) for a, b in got.items()], columns=[*names, "left", "right"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"component {kinds['right']}", f"left {kinds['left']}", f"right {kinds['right']}"])
    return e.select(*names, "left", "right", "gain").groupBy(*names).applyInPandas(run, schema)


def edge_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, right, component) over the edges with a gain. Each left ties its rights to the first of them, so the graph that rounds work on has rights only."""
    real = edges.filter("gain > 0").select(*keys, "left", "right")
    first = F.min("right").over(Window.partitionBy(*keys, "left"))
    star = saved(real.select(*keys, first.alias("a"), F.col("right").alias("b")).distinct())
    return components(star.select(*keys, F.col("b").alias("node")), star.filter("a <> b"), keys).withColumnRenamed("node", "right")
