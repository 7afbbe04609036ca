"""Density clustering of symbols by correlation distance, a partition (sector) at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def partition_of(sector: Column, is_etf: Column) -> Column:
    return F.when(F.coalesce(is_etf, F.lit(False)), "ETF").otherwise(F.coalesce(sector, F.lit("Unknown")))


def keep_variance(x: np.ndarray, share: float) -> np.ndarray:
    """Scores on the principal components that hold so large a share of the variance."""
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    total = np.cumsum(s**2) / max(float((s**2).sum()), 1e-300)
    k = int(np.searchsorted(total, share) + 1)
    return u[:, :k] * s[:k]


def density_labels(dist: np.ndarray, min_size: int, min_samples: int) -> np.ndarray:
    """Labels from 0, -1 for noise: minimum spanning tree of mutual reachability, its tree condensed to clusters of min_size, the most stable kept.

    Of edges with equal weights the one with the smaller ends comes first, so there is one tree.
    """
    n = len(dist)
    if n < max(min_size, 2):
        return np.full(n, -1)
    core = np.sort(dist, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(np.maximum(dist, core[:, None]), core)
    every = np.arange(n)
    inside, best, near, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    ends = lambda a, b: np.minimum(a, b) * n + np.maximum(a, b)
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & ((reach[at] < best) | ((reach[at] == best) & (ends(at, every) < ends(near, every))))
        best[closer], near[closer] = reach[at][closer], at
        out = np.flatnonzero(~inside)
        least = out[best[out] == best[out].min()]
        nxt = int(least[np.argmin(ends(near[least], least))])
        edges.append((float(best[nxt]), int(min(near[nxt], nxt)), int(max(near[nxt], nxt))))
        at = nxt
    return tree_labels(n, edges, min_size)


def tree_labels(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """Labels of n points from the edges (weight, smaller end, larger end) of their spanning tree: merged by weight, condensed to clusters of min_size, the most stable kept. Takes time and room for n points."""
    if n < max(min_size, 2):
        return np.full(n, -1)
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids, height = np.zeros((n - 1, 2), int), np.zeros(n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b = find(a), find(b)
        parent[a] = parent[b] = n + k
        kids[k], height[k], size[n + k] = (a, b), w, size[a] + size[b]
    # Clusters in the order in which they are born, the larger ones first: where each begins in the merge tree, its parent, its gain.
    root, up, gain, below = [2 * n - 2], [-1], [0.0], [[]]
    born, at = [0.0], 0
    while at < len(root):
        node = root[at]
        while node >= n:
            level = 1 / max(height[node - n], 1e-12)
            big = [int(k) for k in kids[node - n] if size[k] >= min_size]
            lost = size[node] - (size[big[0]] if len(big) == 1 else 0)
            gain[at] += lost * (level - born[at])
            if len(big) != 1:
                for k in big:
                    below[at].append(len(root))
                    root.append(k), up.append(at), gain.append(0.0), below.append([]), born.append(level)
                break
            node = big[0]
        at += 1
    value, taken = [0.0] * len(root), [False] * len(root)
    for i in reversed(range(len(root))):
        inner = sum(value[k] for k in below[i])
        taken[i] = gain[i] >= inner if i else not below[i]
        value[i] = gain[i] if taken[i] else inner
    labels, label = np.full(n, -1), 0
    # The topmost clusters that are taken, numbered as a walk from the root meets them.
    walk = [0]
    while walk:
        i = walk.pop()
        if not taken[i]:
            walk += reversed(below[i])
            continue
        points = [root[i]]
        while points:
            p = points.pop()
            if p < n:
                labels[p] = label
            else:
                points += kids[p - n].tolist()
        label += 1
    return labels


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Agglomeration by the least growth of squared error, to k clusters."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        means = np.array([x[g].mean(axis=0) for g in groups])
        size = np.array([len(g) for g in groups], dtype=float)
        cost = ((means[:, None] - means) ** 2).sum(axis=2) * size[:, None] * size / (size[:, None] + size)
        np.fill_diagonal(cost, np.inf)
        a, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
        groups[a] += groups.pop(b) if b > a else groups[b]
        if b < a:
            groups.pop(b)
    labels = np.zeros(len(x), int)
    for i, g in enumerate(groups):
        labels[g] = i
    return labels


def distances(names: list[str], pairs: pd.DataFrame) -> np.ndarray:
    """1 - rho within [0, 2] of sorted names; 1 without a correlation, 0 to itself. pairs: a, b, rho."""
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0.0)
    known = pairs[pairs["rho"].notna()]
    i, j = (np.searchsorted(names, known[c].to_numpy(dtype=object)) for c in ("a", "b"))
    d[i, j] = d[j, i] = np.clip(1 - known["rho"].to_numpy(dtype=float), 0.0, 2.0)
    return d


def kept_components(corr: DataFrame, symbols: DataFrame, share: float = 0.9) -> DataFrame:
    """partition, symbols, components: how many directions hold so much of the variance of a partition's distances."""
    pairs = symbols.select("partition", F.col("symbol").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("rho")).unionByName(corr.select("partition", "a", "b", "rho"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["a"][g["b"].isna()])
        kept = keep_variance(distances(names, g[g["b"].notna()]), share)
        return pd.DataFrame({"partition": g["partition"].iloc[:1], "symbols": len(names), "components": kept.shape[1]})

    return pairs.groupBy("partition").applyInPandas(run, "partition string, symbols long, components long")


def sane(labels: DataFrame, corr: DataFrame, least: float) -> DataFrame:
    """labels with clusters of one symbol, or of a median correlation below ``least``, dissolved into noise (-1). labels: partition, symbol, label; corr: a < b."""
    inner = _inner(labels, corr).groupBy("partition", "label").agg(F.median("rho").alias("m"))  # a cluster's pairs
    good = inner.where(F.col("m") >= least).select("partition", "label", F.lit(True).alias("good"))
    x = labels.join(good, ["partition", "label"], "left")
    return x.select("partition", "symbol", F.when(F.col("good") & (F.col("label") >= 0), F.col("label")).otherwise(-1).alias("label"))


def _inner(labels: DataFrame, corr: DataFrame) -> DataFrame:
    a = labels.select("partition", F.col("symbol").alias("a"), F.col("label").alias("la"))
    b = labels.select("partition", F.col("symbol").alias("b"), F.col("label").alias("lb"))
    return corr.join(a, ["partition", "a"]).join(b, ["partition", "b"]).where("la = lb and la >= 0").select("partition", F.col("la").alias("label"), "rho")


@dataclass
class Clustered:
    """The last clusters, and for which universe and day they were computed."""

    clusters: DataFrame | None = None
    universe: tuple[int, str] | None = None
    at: date | None = None


def universe_name(symbols: DataFrame) -> tuple[int, str]:
    """Number of different symbols, and the sum of their hashes: the same for every order."""
    r = symbols.select("symbol").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("symbol").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return r["n"], r["h"]


def clusters_as_of(last: Clustered, symbols: DataFrame, at: date, compute: Callable[[DataFrame, date], DataFrame], recompute_days: int | None = None) -> Clustered:
    """The last clusters, or new ones: when there are none, the universe has changed, or so many days have gone by (None: never for age)."""
    name = universe_name(symbols)
    old = last.at is not None and recompute_days is not None and (at - last.at).days >= recompute_days
    if last.clusters is not None and last.universe == name and not old:
        return last
    return Clustered(compute(symbols, at), name, at)


def cluster_symbols(corr: DataFrame, symbols: DataFrame, min_size: int = 3, min_samples: int = 2) -> DataFrame:
    """partition, symbol, label; corr: partition, a, b, rho; symbols: partition, symbol. A partition of symbols is one group: its square is what the distances take."""
    pairs = symbols.select("partition", F.col("symbol").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("rho")).unionByName(corr.select("partition", "a", "b", "rho"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["a"][g["b"].isna()])
        d = distances(names, g[g["b"].notna()])
        labels = density_labels(d, min_size, min_samples)
        if (labels < 0).all():
            labels = density_labels(d, min(3, min_size), 1)
        if (labels < 0).all() and len(names) >= 4:
            labels = ward_labels(keep_variance(d, 0.9), max(2, min(max(2, len(names) // 25), min(100, len(names)))))
        for k in set(labels.tolist()):
            if k >= 0 and (labels == k).sum() < 2:
                labels[labels == k] = -1
        return pd.DataFrame({"partition": g["partition"].iloc[0], "symbol": names, "label": labels.astype("int32")})

    return pairs.groupBy("partition").applyInPandas(run, "partition string, symbol string, label int")


def ranked_clusters(labels: DataFrame, corr: DataFrame) -> DataFrame:
    """partition, label, symbol, cluster_rank by mean correlation times size; the noise of all partitions is the last cluster."""
    inner = _inner(labels, corr).groupBy("partition", "label").agg(F.avg("rho").alias("rho"))
    size = labels.where("label >= 0").groupBy("partition", "label").agg(F.count("*").alias("n"))
    gain = size.join(inner, ["partition", "label"], "left").withColumn("gain", F.round(F.coalesce("rho", F.lit(0.0)) * F.col("n"), 9))
    rank = F.row_number().over(W.orderBy(F.desc("gain"), "partition", "label"))  # one row for each cluster
    ranked = gain.withColumn("cluster_rank", rank).select("partition", "label", "cluster_rank")
    last = ranked.agg((F.count("*") + 1).cast("int").alias("last"))
    x = labels.join(ranked, ["partition", "label"], "left").join(F.broadcast(last), F.col("symbol").isNotNull())  # one row
    return x.select("partition", "label", "symbol", F.coalesce("cluster_rank", "last").alias("cluster_rank"))
