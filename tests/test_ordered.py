"""Ranks and running totals in bins, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscope.operators import acquire, ordered, statistics


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_ranks_in_bins(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "ROWS", size)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, 200).astype(float), np.round(rng.normal(size=200), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(float("nan"), 1.0), (None, 2.0)], "x double, y double")
    got = statistics.spearman_of_rows(df, "x", "y", 12).first()
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    assert got["n"] == 200 and abs(got["rho"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    assert tuple(statistics.spearman_of_rows(df.limit(0), "x", "y", 12).first()) == (0, None)
    assert statistics.spearman_of_rows(df.where("x = 1"), "x", "y").first()["rho"] is None


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_accumulation_in_bins(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "ROWS", size)
    rng = np.random.default_rng(4)
    rows = sorted({(None if g == 2 else "ab"[g], int(s), int(k)) for g, s, k in zip(rng.integers(0, 3, 150), rng.integers(-40, 40, 150), rng.integers(0, 25, 150))}, key=str)
    df = spark.createDataFrame(rows, "grp string, step long, species long")
    got = {(r["grp"], r["step"], r["species"]): r["n_species"] for r in acquire.accumulation(df, ["grp"]).collect()}
    want, seen = {}, {}
    for g, s, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen.setdefault(g, set()).add(k)
        want[g, s, k] = len(seen[g])
    assert got == want


def test_no_window_sees_a_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 10)
    df = spark.range(100).select(F.lit("a").alias("grp"), F.col("id").alias("step"), (F.col("id") % 9).alias("species"), F.col("id").cast("double").alias("x"))
    for made, amount in ((acquire.accumulation(df, ["grp"]), "__new"), (statistics.spearman_of_rows(df, "x", "step"), "__n")):
        windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and f"sum({amount}" in line]
        assert windows and all("__bin" in line for line in windows)
