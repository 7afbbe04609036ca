"""Keyed permutations, null baselines, bootstraps in one pass, tails of the exact table test, calendar shifts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import inference, tuning


@pytest.mark.parametrize("size", [1, 2, 3, 5, 97, 1000])
def test_permutation(spark, size):
    x = spark.range(size).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("draw"))
    got = {}
    for r in x.select("draw", "x", tuning.permuted(F.col("x"), F.lit(size), 7, F.col("draw")).alias("y")).orderBy("draw", "x").collect():
        got.setdefault(r["draw"], []).append(r["y"])
    assert all(sorted(v) == list(range(size)) for v in got.values())
    if size > 90:
        assert len({tuple(v) for v in got.values()}) == 4
        assert all(abs(np.corrcoef(v, range(size))[0, 1]) < 0.35 for v in got.values())


def test_null_baseline(spark):
    rng = random.Random(4)
    rows = [(i, "ab"[i % 3 == 0], rng.random(), rng.gauss(0, 1)) for i in range(300)]
    good = spark.createDataFrame([(i, c, s, y + 3 * s) for i, c, s, y in rows], "id long, c string, score double, y double")
    out = {r["null"]: r for r in tuning.null_baseline(good, ["c"], "score", "y", 10, 40, 7, "id").collect()}
    best = [np.mean([y + 3 * s for _, s, y in sorted(((i, s, y) for i, k, s, y in rows if k == c), key=lambda t: -t[1])[:10]]) for c in "ab"]
    for r in out.values():
        assert r["real"] == pytest.approx(np.mean(best)) and r["percentile"] == 100 and r["z"] > 3
        assert abs(r["mean"] - np.mean([y + 3 * s for _, _, s, y in rows])) < 0.3
    noise = spark.createDataFrame(rows, "id long, c string, score double, y double")
    assert all(abs(r["z"]) < 4 for r in tuning.null_baseline(noise, ["c"], "score", "y", 10, 40, 7, "id").collect())


def test_null_baseline_sorts_nothing_for_each_draw(spark):
    df = spark.createDataFrame([(i, "a", float(i), 1.0) for i in range(50)], "id long, c string, score double, y double")
    plan = tuning.null_baseline(df, ["c"], "score", "y", 5, 20, 7, "id")._jdf.queryExecution().optimizedPlan().toString()
    # Draws are exploded over cells and selected places, never over rows.
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert made and not any("__score" in line or "o#" in line.split("[", 2)[-1] for line in made)


def test_weights_and_sums(spark, monkeypatch):
    keys = [0, 1, 2, 5, -3, 2**40, 2**31 - 1, 10**6]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = {(r["k"], r["draw"]): r["w"] for r in df.select("k", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("draw")).select("k", "draw", inference.poisson_weight(7, F.col("draw"), F.col("k")).alias("w")).collect()}
    got = inference._weights(7, 9, np.array(keys))
    assert all(got[i, d - 1] == want[k, d] for (k, d), i in zip(want, (keys.index(k) for k, _ in want), strict=True))
    monkeypatch.setattr(inference, "AT_ONCE", 16)
    monkeypatch.setattr(inference, "GROUPS", 3)
    rows = [(i, f"g{i % 11}" if i % 13 else None, float(i % 7), None if i % 5 == 0 else 1.0) for i in range(500)]
    table = spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(5)
    have = {(r["g"], r["draw"]): (r["sx"], r["sy"]) for r in inference.weighted_sums(table, ["g"], {"sx": F.col("x"), "sy": F.col("y")}, 6, 3, F.col("id")).collect()}
    w = inference._weights(3, 6, np.arange(500))
    for g, d in itertools.product({r[1] for r in rows}, range(1, 7)):
        mine = [r for r in rows if r[1] == g]
        assert have[g, d] == pytest.approx((sum(w[i, d - 1] * x for i, _, x, _ in mine), sum(w[i, d - 1] * (y or 0) for i, _, _, y in mine)))
    assert len(have) == 12 * 6


def test_bootstrap_explodes_no_rows(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, i % 4 == 0) for i in range(100)], "obs_id long, g boolean, e boolean")
    got = inference.bootstrap_rate_gap(df, F.col("g"), F.col("e"), 50, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    r = got.first()
    assert r["low"] < r["mean"] < r["high"]


def slow_fisher(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    ways = lambda x: math.comb(k, x) * math.comb(n - k, r - x)
    return sum(ways(x) for x in range(max(0, r + k - n), min(r, k) + 1) if ways(x) <= ways(a) * (1 + 1e-7)) / math.comb(n, r)


def test_fisher_tails():
    rng = random.Random(2)
    tables = [tuple(rng.randint(0, m) for _ in range(4)) for m in (1, 3, 12, 60) for _ in range(60)] + [(0, 0, 0, 0), (5, 0, 0, 5), (0, 7, 7, 0), (10, 10, 10, 10)]
    for t in tables:
        assert inference.fisher_p(*t) == pytest.approx(slow_fisher(*t), rel=1e-6, abs=1e-12), t
    assert 0 < inference.fisher_p(10**9, 10**9 + 10**5, 10**9, 10**9) < 0.2  # a support of 10^9 tables takes no time
