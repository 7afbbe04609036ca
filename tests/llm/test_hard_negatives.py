"""op12 against all pairs, in one band and slice and in many; awkward vectors; pivots only prune."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from spreadlake.llm import hard_negatives as H


def expected(rows, anchors, positives=5, negatives=5, scale=256):
    """rows and anchors: (id, label, vector); every anchor row is answered for itself."""

    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])

    ints = lambda r: (r[0], r[1], [math.floor(scale * x) for x in r[2]])
    rows, out = [ints(r) for r in rows if usable(r)], []
    for i, label, a in map(ints, filter(usable, anchors)):
        scored = sorted(((sum(x * y for x, y in zip(a, v, strict=False)), j, other) for j, other, v in rows if j != i), key=lambda t: (-t[0], t[1]))
        for p, j, _ in [t for t in scored if t[2] == label][:positives]:
            good = [t for t in scored if t[2] != label and 80 * p <= 100 * t[0] <= 100 * p][:negatives]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(good)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as v", "1 as id", "2 as d", "3 as number", "4 as turn")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, d, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.15) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 32, "FIRST": 2, "BAND": 2, "TOGETHER": 7, "SLICE": 2400}.items():
            monkeypatch.setattr(H, name, value)
    rows = clustered(700, 12, 3)
    rows += [(1000 + i, 1, rows[5][2]) for i in range(40)] + [(2000 + i, 2, rows[5][2]) for i in range(40)]  # ties, and copies under two labels
    rows += [rows[20], (20, 3, rows[21][2])]  # a repeated row, an id that two rows share
    rows += [(3000, None, rows[1][2]), (None, 1, rows[1][2]), (3001, 1, None), (3002, 1, [None] * 12), (3003, 1, [float("nan")] * 12), (3004, 1, [float("inf")] + [0.0] * 11), (3100, 1, []), (3101, 2, [0.5, -0.5]), (3200, 2, [0.0] * 12)]
    anchors = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    df = table(spark, rows)
    have = got(H.hard_negatives(df, df.where("vec_id % 20 = 0")))
    want = expected(rows, anchors)
    assert len(want) > 300 and have == want


def test_components_of_any_size(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.gauss(0, 1) * s for _ in range(4)]) for s, n in ((1, 0), (2.0**11, 50), (2.0**21, 100)) for i in range(n, n + 50)]
    df = table(spark, rows)
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = expected(rows, anchors)
    assert max(abs(w[4]) for w in want) > 2**58
    assert got(H.hard_negatives(df, df.where("vec_id % 10 = 0"))) == want
    far = table(spark, [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1e30])])
    low = table(spark, [(0, 1, [1e30]), (1, 1, [-1e30]), (2, 2, [1.0])])
    assert got(H.hard_negatives(low, low.where("vec_id = 0"))) == []
    with pytest.raises(Exception, match="does not fit a long"):
        H.hard_negatives(far, far.where("vec_id = 0")).collect()


def test_brackets_hold(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 300, (400, 9)) * rng.choice([1, 40], (400, 1)))
    space = H.Space(x[:7], 9, float((x**2).sum(axis=1).max()))
    anchors = x[::5]
    a, v = space.of_anchors(anchors), space.of_vectors(x)
    near = np.abs(a[:, None, :] - v[None]).max(axis=2)
    reach = (a[:, None, :] + v[None]).min(axis=2)
    low, high = space.scores(anchors, near, reach)
    s = anchors @ x.T
    assert (low <= s).all() and (s <= high).all()
    assert (high < 0).sum() + (low > 0).sum() > 0  # and they tell something


def test_brackets_prune(spark):
    rows = clustered(3000, 3, 4)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    space = H.Space(x[:12], 3, float((x**2).sum(axis=1).max()))
    a, v = space.of_anchors(x[:50]), space.of_vectors(x)
    _, high = space.scores(x[:50], np.abs(a[:, None, :] - v[None]).max(axis=2), np.full((50, len(x)), np.inf))
    s = x[:50] @ x.T
    kth = np.sort(s, axis=1)[:, -6]
    assert (high < kth[:, None]).mean() > 0.5


def test_query_relabels(spark, tmp_path):
    rows = clustered(400, 8, 9, labels=10)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<float>) as embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    floats = [(i, (label + 1) % 10 if i % 7 == 0 else label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert got(entry.queries()["op12_hard_negatives"](spark, str(tmp_path))) == expected(floats, [r for r in floats if r[0] % 100 == 0])
