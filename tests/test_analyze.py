"""The whole analysis on planted alignments."""

from pyspark.sql import functions as F

from covertile.params import Params
from covertile.plans.analyze import analyze


def test_planted_addition_is_found(spark):
    rows = []
    for s in ("S1", "S2", "S3"):
        for c in ("d1", "d2", "r1", "r2"):
            step = 4
            rows += [(f"{s}{c}{p}", s, c, p, 60, 0, "50M") for p in range(0, 19_950, step * 50)]
            if s == "S1" and c == "d1":
                rows += [(f"x{p}", s, c, p, 60, 0, "50M") for p in range(8_000, 14_000, 20)]
    reads = spark.createDataFrame(rows, "read string, sample string, rname string, pos long, mapq int, flag int, cigar string")
    targets = spark.createDataFrame([(f"{r[0]}{g}", r, f"{g}", f"{g}", "S" if r == "donor" else "A", 2.0, 20_000) for r in ("donor", "recipient") for g in (1, 2)], "id string, role string, name string, grp string, component string, copy_number double, length long")
    stages = []
    out = analyze(reads, targets, 100, None, Params(min_mb=0.001, bins_mb=(0.001, 0.01, 0.05), alpha=0.01), progress=stages.append)
    calls = out["calls"].filter("sample = 'S1' and grp = '1' and pass").collect()
    assert any(abs(c.start_iid - 40) <= 3 and abs(c.end_iid - 70) <= 3 for c in calls)
    assert out["calls"].filter((F.col("sample") != "S1") & (F.col("score_mean") > 0.5)).count() == 0
    assert stages[0] == "windows" and stages[-1] == "assign"
