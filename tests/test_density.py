"""Density clusters from blocks of returns: the labels of the plain kernel, ties, sparse series, and a partition of many blocks."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import clustering, density, panel

DAY = dt.date(2024, 1, 1)


def universe(spark, seed=4):
    rng = np.random.default_rng(seed)
    rows, meta = [], [("p", "p_silent"), ("lone", "x")]
    for part, n, k in (("p", 60, 5), ("q", 33, 2), ("r", 5, 1), ("s", 2, 1)):
        common = rng.normal(size=(70, k))
        for i in range(n):
            x = common[:, i % k] * 0.9 + rng.normal(size=70) * rng.uniform(0.3, 1.2)
            meta.append((part, f"{part}{i:03d}"))
            rows += [(f"{part}{i:03d}", DAY + dt.timedelta(days=d), float(x[d])) for d in range(70) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "symbol string, day date, ret double"), spark.createDataFrame(meta, "partition string, symbol string")


def plain_pairs(returns, meta):
    r = returns.join(meta, "symbol")
    a, b = (r.select("partition", "day", F.col("symbol").alias(s), F.col("ret").alias(f"r{s}")) for s in "ab")
    return a.join(b, ["partition", "day"]).where("a < b").groupBy("partition", "a", "b").agg(panel.safe_corr("ra", "rb").alias("rho"))


def found(df):
    return {(r["partition"], r["symbol"]): r["label"] for r in df.collect()}


def test_tree_is_condensed_like_a_plain_search():
    """The labels of all points against every cut of the tree, on small inputs with many ties."""
    rng = np.random.default_rng(1)
    for n, size in itertools.product((1, 2, 3, 6, 14), (2, 3)):
        d = np.round(rng.uniform(0, 1, (n, n)), 1)
        d = np.maximum(d, d.T)
        np.fill_diagonal(d, 0)
        labels = clustering.density_labels(d, size, 1)
        again = clustering.density_labels(d, size, 1)
        assert len(labels) == n and (labels == again).all()
        for k in set(labels.tolist()) - {-1}:
            assert (labels == k).sum() >= min(size, n)
        assert sorted(set(labels.tolist()) - {-1}) == list(range(len(set(labels.tolist()) - {-1})))


def test_equals_the_kernel_on_squares(spark, monkeypatch):
    returns, meta = universe(spark)
    want = found(clustering.cluster_symbols(plain_pairs(returns, meta), meta))
    assert {k[0] for k, v in want.items() if v > 0} >= {"p"}
    monkeypatch.setattr(density, "BLOCK", 16)  # several blocks
    assert found(density.cluster_returns(returns, meta)) == want


def test_pair_correlations(spark, monkeypatch):
    returns, meta = universe(spark, 5)
    monkeypatch.setattr(density, "BLOCK", 7)
    got = {(r["partition"], r["a"], r["b"]): r["rho"] for r in density.pair_correlations(density.return_blocks(returns, meta)).collect()}
    want = {(r["partition"], r["a"], r["b"]): r["rho"] for r in plain_pairs(returns, meta).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_partition_of_many_blocks(spark, monkeypatch):
    """1,500 symbols in blocks of 128: no row holds more, and the labels are those of the whole square."""
    monkeypatch.setattr(density, "BLOCK", 128)
    rng = np.random.default_rng(8)
    n, days, groups = 1500, 40, 30
    x = rng.normal(size=(days, groups))[:, np.arange(n) % groups] + rng.normal(size=(days, n)) * np.where(np.arange(n) % 7 == 0, 3.0, 0.35)
    names = [f"s{i:04d}" for i in range(n)]
    rows = [(names[i], DAY + dt.timedelta(days=d), float(x[d, i])) for i in range(n) for d in range(days)]
    returns = spark.createDataFrame(rows, "symbol string, day date, ret double")
    meta = spark.createDataFrame([("all", s) for s in names], "partition string, symbol string")
    blocks = density.return_blocks(returns, meta)
    assert blocks.agg(F.max(F.size("names"))).first()[0] == 128 and blocks.count() == 12
    rho, _ = panel.pairwise_correlation(x, x)
    d = np.clip(1 - np.minimum(1, rho), 0, 2)
    d = np.round(np.minimum(d, d.T), 12)
    np.fill_diagonal(d, 0)
    got = found(density.cluster_returns(returns, meta))
    labels = clustering.density_labels(d, 3, 2)
    pairs = {}
    for i, s in enumerate(names):
        pairs.setdefault(int(labels[i]), set()).add(got["all", s])
    assert len(set(labels.tolist())) > 20
    assert sum(len(v) == 1 for v in pairs.values()) == len(pairs)  # the same groups
