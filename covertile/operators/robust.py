"""Robust corrections: median polish over a cohort, GC regression of single samples, two-component mixtures."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covertile.plans.tables import saved


def polish_sweep(df: DataFrame, row_keys: list[str], col_key: str, value: str) -> DataFrame:
    """One sweep of median polish: less the row's median, then less the column's. NULLs stay NULL."""
    rows = df.groupBy(*row_keys).agg(F.median(value).alias("_r"))
    d = df.join(rows, row_keys).withColumn(value, F.col(value) - F.coalesce("_r", F.lit(0.0))).drop("_r")
    cols = d.groupBy(col_key).agg(F.median(value).alias("_c"))
    return d.join(cols, col_key).withColumn(value, F.col(value) - F.coalesce("_c", F.lit(0.0))).drop("_c")


def _middle(values: Column) -> Column:
    """The median of an array's values without NULLs; NULL if there are none."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def median_polish(df: DataFrame, row_keys: list[str], col_key: str, value: str, max_sweeps: int = 30, tol: float = 1e-6) -> DataFrame:
    """Residuals of the two-way median polish in ``value``; other columns stay, rows without ``col_key`` go.

    Each row's cells are one array of a table that is written once. A median moves with its values, so after columns' effects c a
    row's effect is the median of its cells less c: nothing of a row need be kept from sweep to sweep. A sweep is one scan that
    finds rows' effects inside the arrays and columns' medians by one grouping of their residuals; its outcome is a number for each column.
    Those are broadcast as one array, which is as long as the array of one row. The last sweep is the one after which the
    sum of rows' and columns' absolute effects has changed by less than ``tol``. NULLs stay NULL.
    """
    rest = [c for c in df.columns if c not in (*row_keys, col_key, value)]
    names = df.select(col_key).filter(F.col(col_key).isNotNull()).distinct().withColumn("_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(col_key)) - 1)  # a row for each column
    names = saved(names)
    cells = df.withColumn(value, F.col(value).cast("double")).join(names, col_key)
    rows = saved(cells.groupBy(*row_keys).agg(F.collect_list(F.struct("_pos", F.col(value).alias("_v"), col_key, *rest)).alias("_cells")))

    def with_effects(effects: DataFrame) -> DataFrame:
        """Rows with the columns' effects up to this sweep and the one before, and their own effect."""
        one = effects.agg(*(F.array_sort(F.collect_list(F.struct("_pos", c))).getField(c).alias(c) for c in ("_now", "_was")))
        r = rows.join(F.broadcast(one))
        return r.withColumn("_row", F.coalesce(_middle(F.transform("_cells", lambda x: x["_v"] - F.get(F.col("_was"), x["_pos"]))), F.lit(0.0)))

    effects = names.select("_pos", F.lit(0.0).alias("_now"), F.lit(0.0).alias("_was"))
    total = None
    for _ in range(max_sweeps):
        # what was reached is what this sweep starts from
        r = with_effects(effects.select("_pos", "_now", F.col("_now").alias("_was")))
        # a cell of column -1 brings each row's effect to the same grouping
        cell = lambda pos, d: F.struct(pos.alias("_pos"), d.alias("_d"))
        every = F.concat(F.array(cell(F.lit(-1), F.abs("_row"))), F.transform("_cells", lambda x: cell(x["_pos"], x["_v"] - F.get(F.col("_was"), x["_pos"]) - F.col("_row"))))
        moved = r.select(F.explode(every).alias("_x")).groupBy("_x._pos").agg(F.median("_x._d").alias("_c"), F.sum(F.when(F.col("_x._pos") < 0, F.col("_x._d"))).alias("_rows"))
        moved = saved(moved)
        effects = saved(effects.join(moved.drop("_rows"), "_pos").select("_pos", (F.col("_now") + F.coalesce("_c", F.lit(0.0))).alias("_now"), F.col("_now").alias("_was")))
        was, total = total, effects.select(F.abs("_now").alias("_a")).unionByName(moved.select(F.col("_rows").alias("_a"))).agg(F.sum("_a")).first()[0]
        if total is None or (was is not None and abs(total - was) < tol):
            break
    r = with_effects(effects).select(*row_keys, "_row", "_now", F.explode("_cells").alias("_x"))
    out = r.select(*row_keys, "_x.*", (F.col("_x._v") - F.get(F.col("_now"), F.col("_x._pos")) - F.col("_row")).alias("_residual"))
    return out.withColumn(value, F.col("_residual")).select(*df.columns)


def _spline(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """A natural cubic spline's columns: linear beyond the outer knots."""
    t = knots
    cube = lambda k: np.clip(x - t[k], 0, None) ** 3
    d = lambda k: (cube(k) - cube(len(t) - 1)) / max(t[-1] - t[k], 1e-300)
    return np.stack([x, *(d(k) - d(len(t) - 2) for k in range(len(t) - 2))], axis=1)


def gc_residual(y: np.ndarray, *xs: np.ndarray) -> np.ndarray:
    """y less its spline fit on each x (3 degrees of freedom), fitted to y <= its 90 % quantile, then less its median.

    Rows with a missing value stay missing; with fewer than 20 rows or 3 distinct x only the median is taken away.
    """
    ok = np.isfinite(y) & np.all([np.isfinite(x) for x in xs], axis=0)
    out = np.full(len(y), np.nan)
    if not ok.any():
        return out
    v = y[ok]
    if ok.sum() < 20 or any(len(np.unique(x[ok])) < 3 for x in xs):
        out[ok] = v - np.median(v)
        return out
    kept = v <= np.quantile(v, 0.9)
    columns = [np.ones((ok.sum(), 1))]
    for x in xs:
        q = np.quantile(x[ok][kept], [0, 1 / 3, 2 / 3, 1])
        columns.append(_spline(x[ok], np.unique(q)) if len(np.unique(q)) > 2 else x[ok][:, None])
    a = np.concatenate(columns, axis=1)
    fit = a @ np.linalg.lstsq(a[kept], v[kept], rcond=None)[0]
    out[ok] = v - fit - np.median(v - fit)
    return out


def gc_regression(df: DataFrame, by: list[str], value: str, covariates: list[str]) -> DataFrame:
    """``df`` with ``residual``: ``gc_residual`` within each group of ``by``; a group is one sample's profile, some 10^4 rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = gc_residual(pdf[value].to_numpy(float), *(pdf[c].to_numpy(float) for c in covariates))
        return pdf.assign(residual=pd.Series(r, index=pdf.index).where(np.isfinite(r), None))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "residual double"])
    out = df.groupBy(*by).applyInPandas(run, schema)
    return out.withColumn("residual", F.when(F.isnan("residual"), None).otherwise(F.col("residual")))


def two_normals(x: np.ndarray, weight: np.ndarray, most: int = 200, tol: float = 1e-8) -> dict[str, float]:
    """EM for a mixture of two normal densities on values with weights; starts and floors are fixed values.

    It ends when no parameter moves by ``tol``; a single value has its median and no upper component.
    """
    if weight.sum() < 2:
        mid = float(x[0]) if len(x) else float("nan")
        return {"mu0": mid, "sd0": 1e-6, "w0": 1.0, "mu1": mid, "sd1": 1e-6, "w1": 0.0}
    mu, sd, w = np.array([0.02, 0.75]), np.array([0.05, 0.15]), np.array([0.8, 0.2])
    total = weight.sum()
    for _ in range(most):
        d = w * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
        upper = d[:, 1] / (d.sum(axis=1) + 1e-300)
        p = np.stack([1 - upper, upper], axis=1) * weight[:, None]
        n = np.maximum(p.sum(axis=0), 1e-12)
        new_w, new_mu = p.sum(axis=0) / total, (p * x[:, None]).sum(axis=0) / n
        new_sd = np.sqrt((p * (x[:, None] - new_mu) ** 2).sum(axis=0) / n)
        moved = np.abs(np.concatenate([new_w - w, new_mu - mu, new_sd - sd])).max()
        w, mu, sd = new_w, new_mu, np.maximum(new_sd, 1e-6)
        if moved < tol:
            break
    lo, hi = (0, 1) if mu[0] <= mu[1] else (1, 0)
    return {"mu0": mu[lo], "sd0": sd[lo], "w0": w[lo], "mu1": mu[hi], "sd1": sd[hi], "w1": w[hi]}


MIXTURE = "mu0 double, sd0 double, w0 double, mu1 double, sd1 double, w1 double"


#: Values of a mixture count by bins of this width; of equal values nothing is lost, others agree to a 4096th.
BIN = 2.0**-12


def mixtures(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, the mixture's six numbers): values are counted by bins of ``BIN`` first, each standing at its mean.

    So a group has as many rows as its range has bins, however many values there are: logarithms of ratios within 1e-6 to 1e6 have
    113,000. The bins of a group partly add up before they are shuffled.
    """
    at = F.floor(F.col(value) / BIN)
    counted = values.filter(F.col(value).isNotNull()).groupBy(*by, at.alias("_at")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n")).drop("_at")
    keys = ", ".join(f"`{b}` {dict(values.dtypes)[b]}" for b in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = two_normals(pdf[value].to_numpy(float), pdf["_n"].to_numpy(float))
        return pd.DataFrame([dict(zip(by, key, strict=True)) | m])

    return counted.groupBy(*by).applyInPandas(run, f"{keys}, {MIXTURE}")


def posterior(value: str):
    """The upper component's share at ``value``, from the mixture's columns."""
    dens = lambda k: F.col(f"w{k}") * F.exp(-0.5 * F.pow((F.col(value) - F.col(f"mu{k}")) / F.col(f"sd{k}"), F.lit(2.0))) / (F.col(f"sd{k}") * np.sqrt(2 * np.pi))
    return dens(1) / (dens(0) + dens(1) + F.lit(1e-300))


def normal_quantile(p: float, mu: float, sd: float) -> float:
    return NormalDist(mu, sd).inv_cdf(p)


def median_centred(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.withColumn(value, F.col(value) - F.median(value).over(Window.partitionBy(*by)))
