"""Ranks, quantiles, row numbers and block correlations against plain Python, with a value that half of the rows share."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import gates, metrics, panel, ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [(i, "ab"[i % 2] if i % 5 else "c", 0.0 if rng.random() < 0.5 else round(rng.gauss(0, 1), 1 + i % 3), rng.gauss(0, 1), int(rng.random() < 0.3)) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([*rows, (9999, "a", None, 1.0, None)], "id long, g string, x double, y double, label int")


def average_ranks(v):
    order = sorted(v)
    first, count = {}, {}
    for i, x in enumerate(order):
        first.setdefault(x, i)
        count[x] = count.get(x, 0) + 1
    return [first[x] + (count[x] + 1) / 2 for x in v]


def test_spearman_and_auc(df, rows):
    got = {r["g"]: (r["n"], r["rho"]) for r in panel.spearman(df, ["g"], "x", "y").collect()}
    for g in "abc":
        part = [r for r in rows if r[1] == g]
        want = np.corrcoef(average_ranks([r[2] for r in part]), average_ranks([r[3] for r in part]))[0, 1]
        assert got[g][0] == len(part) and got[g][1] == pytest.approx(want)
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows if a[4] for b in rows if not b[4]]
    assert metrics.auc(df, "label", "x").first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_quantiles(df, rows):
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "x", {"low": 0.1, "mid": 0.5, "high": 0.9, "top": 1.0}).collect()}
    for g in "abc":
        v = np.array([r[2] for r in rows if r[1] == g])
        assert [got[g][c] for c in ("low", "mid", "high", "top")] == pytest.approx([np.quantile(v, p) for p in (0.1, 0.5, 0.9, 1.0)])
    assert ranks.quantiles(df, [], "y", {"m": 0.5}).first()["m"] == pytest.approx(statistics.median([*(r[3] for r in rows), 1.0]))
    assert ranks.quantiles(df.limit(0), [], "y", {"m": 0.5}).first()["m"] is None


def test_numbered_and_bins(df, rows):
    got = {r["id"]: (r["i"], r["n"]) for r in ranks.numbered(df, ["g"], "x", "id", "i", "n").collect()}
    for g in "abc":
        order = sorted((r[2], r[0]) for r in rows if r[1] == g)
        assert [got[i] for _, i in order] == [(k + 1, len(order)) for k in range(len(order))]


def test_left_out_screen(df, rows):
    kept = {r["id"] for r in gates.left_out_screen(df, "g", "y", 0.8).collect()}
    data = [*rows, (9999, "a", None, 1.0, None)]
    least = {g: np.quantile([r[3] for r in data if r[1] != g], 0.8) for g in "abc"}
    assert kept == {r[0] for r in data if r[3] >= least[r[1]]}


def test_correlation_blocks(spark):
    rng = np.random.default_rng(3)
    names = [f"s{i:02d}" for i in range(11)]
    x = rng.normal(size=(40, 11)) + rng.normal(size=(40, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 1.0
    long = [(names[j], i, float(x[i, j])) for i in range(40) for j in range(11) if x[i, j] == x[i, j]]
    got = {(r["a"], r["b"]): r["rho"] for r in panel.correlation_blocks(spark.createDataFrame(long, "symbol string, day int, ret double"), size=4).collect()}
    assert len(got) == 55
    for i in range(11):
        for j in range(i + 1, 11):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if 4 in (i, j) else np.corrcoef(x[ok, i], x[ok, j])[0, 1]
            assert got[names[i], names[j]] == (want if want is None else pytest.approx(want))


def test_trimmed_means(df, rows):
    for r in metrics.trimmed_means(df, "g", "y", "id", 5).collect():
        v = sorted(x[3] for x in [*rows, (9999, "a", None, 1.0, None)] if x[1] == r["g"])
        assert (r["mean"], r["trimmed"]) == pytest.approx((np.mean(v), np.mean(v[5:])))


def test_no_task_holds_a_group(df):
    plan = panel.spearman(df, [], "x", "y")._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "SinglePartition" in line]
    # What meets in one task are partial sums and a row for each bucket.
    assert below and all("HashAggregate" in line and ("__id" in line or "partial_" in line) for line in below)
