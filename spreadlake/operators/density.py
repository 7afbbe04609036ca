"""Density clusters of partitions of any size, from returns: no square of distances is ever in one place.

A partition's symbols lie in blocks of BLOCK; a block's returns are one row, written once.  A unit is a pair of blocks, and a task works out
the distances between their symbols and keeps little of them.  The first pass keeps each symbol's nearest distances, which give its core
distance.  Then come Boruvka rounds on mutual reachability: every unit yields, for each symbol, the lightest edge to another
component, these are reduced to one for each component, and components join along them; their number at least halves in a round.
Edges are in a strict order (weight, then names), so the tree is that of ``density_labels``.  What is left, one edge for each
symbol, is condensed to clusters partition by partition, in time and room for its symbols.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from .clustering import keep_variance, tree_labels, ward_labels
from .panel import pairwise_correlation

BLOCK = 256
WARD_MOST = 4096  # symbols of a partition without any dense cluster, whose square of distances is taken as a whole


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/density-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def return_blocks(returns: DataFrame, symbols: DataFrame, size: int | None = None) -> DataFrame:
    """partition, block, names, days, returns of BLOCK symbols: days by symbols as bytes. returns: symbol, day, ret; symbols: partition, symbol."""
    w = W.partitionBy("partition").orderBy("symbol")  # a row for each symbol
    named = symbols.select("partition", "symbol").distinct().withColumn("block", F.floor((F.row_number().over(w) - 1) / (size or BLOCK)).cast("int"))
    rows = named.join(returns.where(F.col("ret").isNotNull()).select("symbol", F.unix_date("day").alias("day"), F.col("ret").cast("double").alias("ret")), "symbol", "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["symbol"]))
        told = g[g["day"].notna()]
        days = np.sort(told["day"].unique()).astype(np.int64)
        m = np.full((len(days), len(names)), np.nan)
        m[np.searchsorted(days, told["day"].to_numpy(dtype=np.int64)), np.searchsorted(names, told["symbol"].to_numpy(dtype=object))] = told["ret"].to_numpy(dtype=float)
        return pd.DataFrame({"partition": g["partition"].iloc[:1], "block": g["block"].iloc[:1], "names": [names], "days": [days.tobytes()], "ret": [m.tobytes()]})

    return _written(rows.groupBy("partition", "block").applyInPandas(run, "partition string, block int, names array<string>, days binary, ret binary"))


def _units(blocks: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Each pair of blocks of a partition, i <= j, with both blocks' returns, and their symbols' cores and components in order if a state is given."""
    if state is not None:
        told = state.groupBy("partition", "block").agg(F.sort_array(F.collect_list(F.struct("symbol", "core", "comp"))).alias("s"))  # a block's symbols
        blocks = blocks.join(told.select("partition", "block", F.col("s.core").alias("core"), F.col("s.comp").alias("comp")), ["partition", "block"])
    last = blocks.groupBy("partition").agg(F.max("block").alias("last"))
    side = lambda s: blocks.select("partition", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c != "partition"])
    pairs = blocks.select("partition", F.col("block").alias("block_a")).join(last, "partition").select("partition", "block_a", F.explode(F.sequence("block_a", "last")).alias("block_b"))
    return pairs.join(side("a"), ["partition", "block_a"]).join(side("b"), ["partition", "block_b"])


def _correlations(r) -> tuple[np.ndarray, np.ndarray]:
    """(rho, n) of the unit's symbols."""
    days = [np.frombuffer(r[f"days_{s}"], dtype=np.int64) for s in "ab"]
    values = [np.frombuffer(r[f"ret_{s}"]).reshape(len(d), len(r[f"names_{s}"])) for s, d in zip("ab", days, strict=True)]
    both = np.intersect1d(*days)
    x, y = (v[np.searchsorted(d, both)] for v, d in zip(values, days, strict=True))
    return pairwise_correlation(x, y)


def _distances(r) -> np.ndarray:
    """1 - rho within [0, 2] of the unit's symbols, 1 without a correlation, 0 to itself."""
    rho, _ = _correlations(r)
    d = np.where(np.isnan(rho), 1.0, np.clip(1 - rho, 0.0, 2.0))
    if r["block_a"] == r["block_b"]:
        d = np.minimum(d, d.T)  # the same number on both sides
        np.fill_diagonal(d, 0.0)
    return d


def pair_correlations(blocks: DataFrame) -> DataFrame:
    """partition, a < b, rho of symbols of a partition with common days; null where one of them doesn't vary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                rho, n = _correlations(r)
                i, j = np.nonzero(n > 0)
                a, b = np.asarray(r["names_a"], dtype=object)[i], np.asarray(r["names_b"], dtype=object)[j]
                out = pd.DataFrame({"partition": r["partition"], "a": a, "b": b, "rho": rho[i, j]})
                yield out[out["a"] < out["b"]]

    got = _units(blocks).mapInPandas(run, "partition string, a string, b string, rho double")
    return got.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def _sides(r, d: np.ndarray) -> Iterator[tuple[str, str, np.ndarray]]:
    yield "a", "b", d
    if r["block_a"] != r["block_b"]:
        yield "b", "a", d.T


def core_distances(blocks: DataFrame, samples: int) -> DataFrame:
    """partition, block, symbol, core: the distance to the symbol's nearest but so many; to the farthest, if there are fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                d = _distances(r)
                for s, _, m in _sides(r, d):
                    m = m.astype(float)
                    if r["block_a"] == r["block_b"]:
                        m = m + np.where(np.eye(len(m), dtype=bool), np.inf, 0.0)  # without itself
                    m = np.sort(m, axis=1)[:, :samples]
                    i, k = np.nonzero(np.isfinite(m))
                    yield pd.DataFrame({"partition": r["partition"], "block": r[f"block_{s}"], "symbol": np.asarray(r[f"names_{s}"], dtype=object)[i], "d": m[i, k]})

    near = _units(blocks).mapInPandas(run, "partition string, block int, symbol string, d double")
    w = W.partitionBy("partition", "symbol").orderBy("d")  # samples distances of each block
    nearest = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).groupBy("partition", "symbol").agg(F.max("d").alias("core"))
    named = blocks.select("partition", "block", F.explode("names").alias("symbol"))
    return named.join(nearest, ["partition", "symbol"], "left").select("partition", "block", "symbol", F.coalesce("core", F.lit(0.0)).alias("core"))


def spanning_tree(blocks: DataFrame, samples: int) -> DataFrame:
    """partition, w, a, b: the edges of the minimum spanning tree of mutual reachability, a < b."""
    state = _written(core_distances(blocks, samples).withColumn("comp", F.col("symbol")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                d = _distances(r)
                d = np.maximum(np.maximum(d, np.asarray(r["core_a"])[:, None]), np.asarray(r["core_b"]))
                d = np.where(np.asarray(r["comp_a"], dtype=object)[:, None] == np.asarray(r["comp_b"], dtype=object), np.inf, d)
                for s, o, m in _sides(r, d):
                    j = m.argmin(axis=1)  # of equal ones the first name
                    i = np.flatnonzero(np.isfinite(m[np.arange(len(m)), j]))
                    j = j[i]
                    mine, other = np.asarray(r[f"names_{s}"], dtype=object)[i], np.asarray(r[f"names_{o}"], dtype=object)[j]
                    swap = mine > other
                    yield pd.DataFrame({"partition": r["partition"], "comp": np.asarray(r[f"comp_{s}"], dtype=object)[i], "to": np.asarray(r[f"comp_{o}"], dtype=object)[j], "w": m[i, j], "a": np.where(swap, other, mine), "b": np.where(swap, mine, other)})

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        """comp and the smallest component that it is now one with; a row for each component of a partition."""
        up = {c: c for c in [*g["comp"], *g["to"]]}

        def find(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for c, to in zip(g["comp"], g["to"], strict=True):
            c, to = find(c), find(to)
            up[max(c, to)] = min(c, to)
        return pd.DataFrame({"partition": g["partition"].iloc[0], "comp": list(up), "root": [find(c) for c in up]})

    edges = None
    while True:
        lightest = _units(blocks, state).mapInPandas(run, "partition string, comp string, to string, w double, a string, b string")
        best = _written(lightest.groupBy("partition", "comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("partition", "comp", "e.*"))
        if best.isEmpty():
            break
        found = best.select("partition", "w", "a", "b").distinct()
        edges = found if edges is None else edges.unionByName(found)
        roots = best.select("partition", "comp", "to").groupBy("partition").applyInPandas(joined, "partition string, comp string, root string")
        state = _written(state.join(roots, ["partition", "comp"], "left").select("partition", "block", "symbol", "core", F.coalesce("root", "comp").alias("comp")))
    return edges if edges is not None else blocks.sparkSession.createDataFrame([], "partition string, w double, a string, b string")


def _labelled(blocks: DataFrame, min_size: int, samples: int) -> DataFrame:
    """partition, symbol, label."""
    points = blocks.select("partition", F.lit(None).cast("double").alias("w"), F.explode("names").alias("a"), F.lit(None).cast("string").alias("b"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["a"][g["b"].isna()])
        tree = g[g["b"].notna()]
        a, b = (np.searchsorted(names, tree[c].to_numpy(dtype=object)) for c in ("a", "b"))
        labels = tree_labels(len(names), list(zip(tree["w"].tolist(), a.tolist(), b.tolist(), strict=True)), min_size)
        return pd.DataFrame({"partition": g["partition"].iloc[0], "symbol": names, "label": labels.astype("int32")})

    return points.unionByName(spanning_tree(blocks, samples)).groupBy("partition").applyInPandas(run, "partition string, symbol string, label int")


def _ward(blocks: DataFrame) -> DataFrame:
    """partition, symbol, label by agglomeration, for partitions of 4 symbols or more and WARD_MOST at most: more are an error."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(n for side in g[g["block_a"] == g["block_b"]]["names_a"] for n in side)
        if len(names) > WARD_MOST:
            raise ValueError(f"a partition of {len(names)} symbols without a dense cluster")
        d = np.zeros((len(names), len(names)))
        for _, r in g.iterrows():
            i, j = (np.searchsorted(names, np.asarray(r[f"names_{s}"], dtype=object)) for s in "ab")
            d[np.ix_(i, j)] = _distances(r)
            d[np.ix_(j, i)] = d[np.ix_(i, j)].T
        n = len(names)
        labels = ward_labels(keep_variance(d, 0.9), max(2, min(max(2, n // 25), min(100, n)))) if n >= 4 else np.full(n, -1)
        return pd.DataFrame({"partition": g["partition"].iloc[0], "symbol": names, "label": labels.astype("int32")})

    return _units(blocks).groupBy("partition").applyInPandas(run, "partition string, symbol string, label int")


def cluster_returns(returns: DataFrame, symbols: DataFrame, min_size: int = 3, min_samples: int = 2) -> DataFrame:
    """partition, symbol, label as ``cluster_symbols`` has them: where nothing is dense, with fewer samples, then by agglomeration; clusters of one are noise."""
    blocks = return_blocks(returns, symbols)
    done, left = None, blocks
    for size, samples in ((min_size, min_samples), (min(3, min_size), 1)):
        labels = _written(_labelled(left, size, samples))
        dense = labels.where("label >= 0").select("partition").distinct()
        good = labels.join(dense, "partition", "left_semi")
        done = good if done is None else done.unionByName(good)
        left = left.join(dense, "partition", "left_anti")
        if left.isEmpty():
            break
    else:
        done = done.unionByName(_ward(left))
    lone = done.groupBy("partition", "label").agg(F.count("*").alias("n")).where("n < 2 and label >= 0")
    return done.join(lone.withColumn("lone", F.lit(True)).drop("n"), ["partition", "label"], "left").select("partition", "symbol", F.when(F.col("lone"), -1).otherwise(F.col("label")).cast("int").alias("label"))
