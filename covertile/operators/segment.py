"""Segmentation of score profiles by circular binary segmentation, and evidence of segments."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache
from math import exp, lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.operators.intervals import gap_merge
from covertile.params import Params


def spread(x: np.ndarray, trim: float = 0.025) -> float:
    """Standard deviation of the noise, from differences of neighbours without the largest 2 ``trim`` of them, which are changes rather than noise."""
    d = np.sort(np.abs(np.diff(x)))
    kept = d[: max(1, round((1 - 2 * trim) * len(d)))]
    a = NormalDist().inv_cdf(1 - trim)
    within = 1 - 2 * a * np.exp(-a * a / 2) / np.sqrt(2 * np.pi) / (1 - 2 * trim)  # variance of a normal variable between -a and a
    return float(np.sqrt(max((kept**2).mean() / 2 / within, 1e-300)))


def smooth_outliers(x: np.ndarray, region: int = 10, far: float = 4.0, near: float = 2.0) -> np.ndarray:
    """Points more than ``far`` sd beyond all of their ``region`` neighbours on each side come back to within ``near`` sd of the median around them."""
    if len(x) < 2:
        return x
    sd = spread(x)
    wide = np.pad(x, region, constant_values=np.nan)
    around = np.lib.stride_tricks.sliding_window_view(wide, 2 * region + 1)
    others = np.delete(around, region, axis=1)
    up = x > np.nanmax(others, axis=1) + far * sd
    down = x < np.nanmin(others, axis=1) - far * sd
    out = x.copy()
    if up.any() or down.any():
        mid = np.nanmedian(around, axis=1)
        out[up], out[down] = mid[up] + near * sd, mid[down] - near * sd
    return out


#: Permutations of a test; points from which on long arcs have a tail probability instead; the longest arc that is permuted then.
PERMUTATIONS, LONG, SHORT_ARC = 10_000, 200, 25
#: Chance of ending a test early with another outcome than all its permutations would have.
EARLY = 0.05


def _sums(rows: np.ndarray) -> np.ndarray:
    """Running sums of centred rows, from 0 to 0."""
    return np.concatenate([np.zeros((len(rows), 1)), np.cumsum(rows - rows.mean(axis=1, keepdims=True), axis=1)], axis=1)


def _best_arc(x: np.ndarray, least: int) -> tuple[float, int, int]:
    """(sum of squares between, i, j) of the arc (i, j] whose mean differs most from the rest. The profile is a circle, and arcs and what is left of
    it at either end have ``least`` points."""
    n = len(x)
    s = _sums(x[None, :])[0]
    j = np.arange(least, n - least + 1)
    ends = s[j] ** 2 * n / (j * (n - j))
    k = int(ends.argmax())
    top, at = float(ends[k]), (0, int(j[k]))
    for size in range(least, n - 2 * least + 1):
        d = (s[least + size : n - least + 1] - s[least : n - least + 1 - size]) ** 2
        k = int(d.argmax())
        stat = d[k] * n / (size * (n - size))
        if stat > top:
            top, at = float(stat), (least + k, least + k + size)
    return top, *at


def _peaks(rows: np.ndarray, least: int, longest: int) -> np.ndarray:
    """The largest sum of squares over each row's arcs, as ``_best_arc`` takes them, that have ``longest`` points or fewer inside or outside."""
    n = rows.shape[1]
    s = _sums(rows)
    j = np.arange(least, n - least + 1)
    j = j[np.minimum(j, n - j) <= longest]
    top = (s[:, j] ** 2 * (n / (j * (n - j)))).max(axis=1) if len(j) else np.zeros(len(rows))
    for size in range(least, n - 2 * least + 1):
        if min(size, n - size) <= longest:
            d = s[:, least + size : n - least + 1] - s[:, least : n - least + 1 - size]
            np.maximum(top, np.square(d).max(axis=1) * (n / (size * (n - size))), out=top)
    return top


def tail(b: float, shortest: int, n: int) -> float:
    """Chance that the largest two-sided standardised difference over circular arcs of a profile of noise exceeds b, arcs of ``shortest`` points to as many outside.

    2 b^3 phi(b) / 4 times the integral of nu(b / sqrt(n t (1 - t)))^2 / (t^2 (1 - t)) over the arcs' share t.
    """
    if b <= 0 or 2 * shortest >= n:
        return 1.0 if b <= 0 else 0.0
    edges = np.linspace(shortest / n, 1 - shortest / n, 401)
    t = (edges[1:] + edges[:-1]) / 2
    half = b / np.sqrt(n * t * (1 - t)) / 2
    normal = NormalDist()
    cdf = np.array([normal.cdf(v) for v in half])
    nu = (cdf - 0.5) / half / (half * cdf + np.exp(-half * half / 2) / np.sqrt(2 * np.pi))
    total = (nu**2 / (t**2 * (1 - t)) * np.diff(edges)).sum()
    return float(min(1.0, b**3 * np.exp(-b * b / 2) / np.sqrt(2 * np.pi) / 2 * total))


@cache
def boundary(allowed: int, permutations: int = PERMUTATIONS, early: float = EARLY) -> tuple[int, ...]:
    """For k = 1, 2, ...: the number of permutations after which fewer than k exceedances end a test as significant.

    Were one more than ``allowed`` of all permutations to exceed, the k-th would come that late with a chance of early / (allowed + 1).
    The same for profiles of every length.
    """
    ones = allowed + 1

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    def later(k: int, m: int) -> float:
        whole = log_choose(permutations, ones)
        return sum(exp(log_choose(m, i) + log_choose(permutations - m, ones - i) - whole) for i in range(k) if i <= m and ones - i <= permutations - m)

    out = []
    for k in range(1, ones + 1):
        lo, hi = (out[-1] if out else 0), permutations
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if later(k, mid) <= early / ones else (mid + 1, hi)
        out.append(lo)
    return tuple(out)


def _exceeds(draw: Callable[[int], np.ndarray], allowed: int, cost: int) -> bool:
    """Whether at most ``allowed`` of the permutations exceed what was observed; ``draw`` makes so many and tells which do. Ends at the boundary."""
    if allowed < 0:
        return False
    ends = np.array(boundary(allowed))
    done, above, size = 0, 0, 32
    while done < PERMUTATIONS:
        hits = draw(min(size, PERMUTATIONS - done))
        at = done + np.arange(1, len(hits) + 1)
        so_far = above + np.cumsum(hits)
        if (so_far > allowed).any() or (at >= ends[np.minimum(so_far, allowed)]).any():
            lost, won = np.argmax(np.append(so_far > allowed, True)), np.argmax(np.append((so_far <= allowed) & (at >= ends[np.minimum(so_far, allowed)]), True))
            return bool(won < lost)
        done, above = done + len(hits), int(so_far[-1])
        size = max(1, min(2 * size, 400_000 // cost))
    return True


def _split(x: np.ndarray, alpha: float, least: int, rng: np.random.Generator) -> list[int]:
    """Inner change points of one stretch: those of its best arc, if noise rarely has one like it.

    Up to ``LONG`` points all arcs are permuted. Beyond, arcs of over ``SHORT_ARC`` points have their tail probability and the permutations of the
    short ones must stay below what that leaves of alpha. Each end of an inner arc must part its two neighbours too.
    """
    n = len(x)
    if n < 2 * least:
        return []
    stat, i, j = _best_arc(x, least)
    total = ((x - x.mean()) ** 2).sum()
    if total <= 1e-12:
        return []
    longest, level = n, alpha
    t2 = stat / max(total - stat, 1e-300) * (n - 2)
    if n > LONG:
        longest = max(SHORT_ARC, least)
        level = alpha - tail(float(np.sqrt(t2)), longest + 1, n)
        if level <= 0:
            return []
    allowed = int(level * PERMUTATIONS + 1e-9)

    def arcs(size: int) -> np.ndarray:
        return _peaks(rng.permuted(np.broadcast_to(x, (size, n)), axis=1), least, longest) >= stat

    if not _exceeds(arcs, allowed, n):
        return []
    if i == 0 or j == n:
        return [p for p in (i, j) if 0 < p < n]
    return [p for p, a, b in ((i, 0, j), (j, i, n)) if _parts(x[a:b], p - a, alpha, rng)]


def _parts(x: np.ndarray, at: int, alpha: float, rng: np.random.Generator) -> bool:
    """Whether the means before and from ``at`` on differ more than all but alpha of the permutations' do."""
    seen = abs(x[:at].sum() - at * x.mean())

    def means(size: int) -> np.ndarray:
        rows = rng.permuted(np.broadcast_to(x, (size, len(x))), axis=1)
        return np.abs(rows[:, :at].sum(axis=1) - at * x.mean()) >= seen - 1e-12

    return _exceeds(means, int(alpha * PERMUTATIONS + 1e-9), len(x))


def segment_profile(x: np.ndarray, alpha: float = 0.001, undo_sd: float = 1.0, least: int = 5, seed: int = 0) -> list[tuple[int, int, float]]:
    """(first, last, mean of the smoothed points) of the segments of a profile without gaps; none if it has fewer than max(20, least) points."""
    if len(x) < max(20, least):
        return []
    rng = np.random.Generator(np.random.PCG64(seed))
    y = smooth_outliers(x)
    done, todo = [0, len(y)], [(0, len(y))]
    while todo:
        a, b = todo.pop()
        cuts = [a, *(a + p for p in _split(y[a:b], alpha, least, rng)), b]
        if len(cuts) > 2:
            done += cuts[1:-1]
            todo += list(zip(cuts[:-1], cuts[1:], strict=True))
    cuts = sorted(set(done))
    sd = spread(y)
    while len(cuts) > 2:  # changes of medians under undo_sd standard deviations are undone, smallest first
        jump = np.abs(np.diff([np.median(y[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        k = int(jump.argmin())
        if jump[k] >= undo_sd * sd:
            break
        del cuts[k + 1]
    return [(a, b - 1, float(y[a:b].mean())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def segments(scores: DataFrame, params: Params = Params()) -> DataFrame:
    """(sample, grp, start_iid, end_iid, n_windows, score_mean) of each profile; windows without a score are passed over.

    Profiles are independent groups of one row a window (n of the tiling: thousands, whatever the number of reads); permutations are seeded by sample and group.
    """
    alpha, undo, least = params.alpha, params.undo_sd, params.min_width

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iid")
        iid, x = pdf["iid"].to_numpy(), pdf["score"].to_numpy(float)
        seed = zlib.crc32("\x00".join(map(str, key)).encode())
        out = [(*key, int(iid[a]), int(iid[b]), b - a + 1, m) for a, b, m in segment_profile(x, alpha, undo, least, seed)]
        return pd.DataFrame(out, columns=["sample", "grp", "start_iid", "end_iid", "n_windows", "score_mean"])

    return scores.filter("score is not null").select("sample", "grp", "iid", "score").groupBy("sample", "grp").applyInPandas(run, "sample string, grp string, start_iid long, end_iid long, n_windows long, score_mean double")


EVIDENCE = ["donor_residual", "recipient_residual", "total_residual", "donor_spread", "recipient_spread", "supported_donors", "mapq_high_fraction"]


def evidence(segs: DataFrame, scores: DataFrame, columns: list[str] = EVIDENCE) -> DataFrame:
    """Segments with the means of the windows inside them that are not masked. Windows meet segments by an equi-join."""
    have = [c for c in columns if c in scores.columns]
    inside = segs.select("sample", "grp", "start_iid", F.explode(F.sequence("start_iid", "end_iid")).alias("iid"))
    unmasked = scores.filter(~F.coalesce("masked", F.lit(False))) if "masked" in scores.columns else scores
    means = inside.join(unmasked.select("sample", "grp", "iid", *have), ["sample", "grp", "iid"]).groupBy("sample", "grp", "start_iid").agg(*(F.avg(c).alias(c) for c in have))
    return segs.join(means, ["sample", "grp", "start_iid"], "left")


def coordinates(segs: DataFrame, group_lengths: DataFrame, n: int) -> DataFrame:
    """Segments with start_bp, end_bp and width_bp on the donor group's length (grp, length), and donor_length."""
    j = segs.join(group_lengths, "grp")
    j = j.withColumns({"start_bp": F.expr(f"start_iid * length div {n}"), "end_bp": F.expr(f"(end_iid + 1) * length div {n}")})
    return j.withColumn("width_bp", F.col("end_bp") - F.col("start_bp")).withColumnRenamed("length", "donor_length")


def call_segments(scores: DataFrame, group_lengths: DataFrame, n: int, params: Params = Params()) -> DataFrame:
    """Segments, joined over short gaps, with evidence and coordinates, of at least ``min_mb``."""
    segs = gap_merge(segments(scores, params), scores.select("sample", "grp", "iid", "score"), ["sample", "grp"], params.merge_gap, params.merge_floor, params.merge_min)
    return coordinates(evidence(segs, scores), group_lengths, n).filter(F.col("width_bp") >= params.min_mb * 1e6)
