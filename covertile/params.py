"""Parameters of an analysis: named profiles, overrides and their ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MODES = ("single", "multi")


@dataclass(frozen=True)
class Params:
    """Lengths are in bases, scores in natural-log ratios."""

    windows: int = 1000
    min_mapq: int = 20
    eps: float = 1e-4
    metric: str = "breadth"
    donor_aggregation: str = "max"
    score_type: str = "ratio"
    mask_z: float = 0.5
    alpha: float = 0.001
    undo_sd: float = 1.0
    min_width: int = 5
    merge_gap: int = 100
    merge_floor: float = -0.5
    merge_min: float = 0.5
    min_mb: float = 5.0
    bins_mb: tuple[float, ...] = (5.0, 10.0, 25.0, 50.0, 100.0)
    floors_single: tuple[float, ...] = (2.0, 1.5, 1.2, 1.0, 0.5)
    floors_multi: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25, 0.25)
    fdr: float = 0.01
    donor_mod: float = 0.5
    donor_high: float = 1.0
    loss_mod: float = -0.5
    loss_high: float = -1.0
    total_mod: float = 0.5
    total_high: float = 1.0
    min_depletion: float = 0.5
    strong_depletion: float = 1.5
    run_threshold: float = 1.0
    assignment_margin: float = 0.5
    cross_margin: float = 2.0
    min_expected_breadth: float = 0.001
    relative_floor: float = 0.1
    loss_depletion: float = 1.5
    same_group_bonus: float = 1.0
    width_lambda: float = 2.0
    whole_penalty: float = 8.0

    def floors(self, mode: str) -> tuple[float, ...]:
        """One floor for each length bin; a list of another length is stretched by linear interpolation."""
        own = self.floors_single if mode == "single" else self.floors_multi
        return stretch(own, len(self.bins_mb))


def stretch(values: tuple[float, ...], n: int) -> tuple[float, ...]:
    if len(values) == n:
        return tuple(values)
    return tuple(np.interp(np.linspace(0, len(values) - 1, n), np.arange(len(values)), values).tolist())


RANGES = {
    "alpha": (0.0, 1.0), "fdr": (0.0, 1.0), "eps": (0.0, 1.0), "undo_sd": (0.0, 10.0), "min_width": (2, 10_000), "merge_gap": (0, 1_000_000),
    "merge_floor": (-100.0, 100.0), "min_mb": (0.0, 1e6), "mask_z": (-100.0, 100.0), "assignment_margin": (0.0, 100.0), "cross_margin": (0.0, 100.0), "min_depletion": (-100.0, 100.0),
}

#: Changes of each profile against the defaults (fixed values); "custom" changes nothing.
PROFILES: dict[str, dict] = {
    "balanced": {},
    "sensitive": {"windows": 100, "metric": "combined", "floors_single": (1.5, 1.2, 1.0, 0.8, 0.4)},
    "cnv_robust": {"windows": 100, "score_type": "donor", "floors_single": (1.5, 1.2, 1.0, 0.8, 0.4)},
    "complex": {"metric": "combined"},
    "custom": {},
}
#: What a profile says besides the thresholds, in the order in which it is listed.
PROFILE_FIELDS = ("windows", "metric", "score_type", "donor_aggregation", "min_mapq", "fdr", "floors_single", "min_mb", "merge_gap")


def profiles(spark: SparkSession) -> DataFrame:
    """(profile, parameter, value, is_default): the flat view of every named profile."""
    rows = []
    for name in PROFILES:
        own, base = asdict(resolve(name)), asdict(Params())
        rows += [(name, k, str(own[k]), own[k] == base[k]) for k in PROFILE_FIELDS]
    return spark.createDataFrame(rows, "profile string, parameter string, value string, is_default boolean")


def resolve(profile: str = "balanced", registry: dict | None = None, overrides: dict | None = None) -> Params:
    """Override before registry before profile before default; unknown names and values out of range are refused."""
    known = {f.name for f in fields(Params)}
    chosen: dict = {}
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; there are {sorted(PROFILES)}")
    for source in (PROFILES[profile], registry or {}, overrides or {}):
        unknown = set(source) - known
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        chosen |= {k: v for k, v in source.items() if v is not None}
    for k, v in chosen.items():
        if k in RANGES and not RANGES[k][0] <= v <= RANGES[k][1]:
            raise ValueError(f"{k} = {v} is outside {RANGES[k]}")
    return replace(Params(), **chosen)


def flat(spark: SparkSession, params: Params) -> DataFrame:
    """(parameter, value) of one set."""
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(params).items()], "parameter string, value string")


def changed(spark: SparkSession, params: Params) -> DataFrame:
    """(parameter, value, default_value) of what differs from the defaults."""
    base = flat(spark, Params()).withColumnRenamed("value", "default_value")
    return flat(spark, params).join(base, "parameter", "full").filter("value is distinct from default_value")
