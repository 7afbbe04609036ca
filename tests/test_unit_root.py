"""Unit-root tests from moments against the regressions of one series at a time."""

import math

import numpy as np
import pytest

from spreadlake.operators import cointegration as K
from spreadlake.operators import unit_root as U


def walks(seed, n_series=24):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n_series):
        n = int(rng.integers(20, 320))
        phi, e = rng.choice([1.0, 0.97, 0.8, 0.2]), rng.normal(size=n + 1) * 0.02
        s = np.zeros(n)
        for t in range(1, n):
            s[t] = phi * s[t - 1] + e[t] + 0.4 * e[t - 1]
        out[f"k{i}"] = s + 5.0 * (i % 3)
    return out


@pytest.mark.parametrize("constant", [False, True])
def test_statistics(spark, constant):
    series = walks(3)
    rows = [(k, t, float(x)) for k, s in series.items() for t, x in enumerate(s)]
    rows += [("short", t, float(t % 3)) for t in range(5)] + [("flat", t, 2.5) for t in range(40)] + [("hole", t, None if t == 7 else float(t * t % 11)) for t in range(40)] + [("one", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5)
    got = {r["k"]: r for r in U.statistics(df, ["k"], "t", "x", constant).collect()}
    assert set(got) == {*series, "short", "flat", "hole", "one"}
    for k, s in series.items():
        want = K.adf_tau(s, constant)
        assert got[k]["n"] == len(s) and got[k]["tau"] == pytest.approx(want, rel=1e-8, abs=1e-8)
    assert got["short"]["tau"] == pytest.approx(K.adf_tau(np.arange(5) % 3 * 1.0, constant), rel=1e-8)
    assert got["flat"]["tau"] == -math.inf and got["hole"]["tau"] is None and got["one"]["tau"] == -math.inf


def test_cointegration(spark):
    rng = np.random.default_rng(5)
    pairs = {}
    for i in range(12):
        n = int(rng.integers(15, 260))
        lag = np.exp(np.cumsum(rng.normal(size=n) * 0.02) + 3)
        lead = np.exp(0.6 * np.log(lag) + 1 + (np.cumsum(rng.normal(size=n)) if i % 2 else rng.normal(size=n)) * 0.01)
        pairs["a", f"b{i}"] = lead, lag
    pairs["a", "same"] = (pairs["a", "b1"][1] * 2,) * 2
    pairs["a", "const"] = pairs["a", "b2"][0], np.full(len(pairs["a", "b2"][0]), 7.0)
    rows = [(*k, t, float(a), float(b)) for k, (x, y) in pairs.items() for t, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("a", "hole", t, None if t == 3 else 5.0 + t % 4, 6.0 + t % 3) for t in range(60)]
    got = {(r["lead"], r["lag"]): r for r in K.cointegration(spark.createDataFrame(rows, "lead string, lag string, pos int, pl double, pg double")).collect()}
    for k, (x, y) in pairs.items():
        p = K.coint_p(np.log(x), np.log(y))
        p = 1.0 if p is None else p
        assert got[k]["coint_pvalue"] == pytest.approx(p, abs=1e-8) and got[k]["coint_score"] == pytest.approx(max(0.0, 1 - p / 0.2), abs=1e-7)
    assert got["a", "hole"]["coint_pvalue"] == 1.0 and got["a", "same"]["coint_pvalue"] == 0.0


def test_no_python_groups(spark):
    df = spark.createDataFrame([("k", 1, 1.0)], "k string, t int, x double")
    plan = U.statistics(df, ["k"], "t", "x", True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
