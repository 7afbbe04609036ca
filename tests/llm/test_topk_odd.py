"""op1: vectors of other dimensions and of great length, in many slices, blocks and bands, against all pairs."""

import math
import random
from collections import Counter

import pytest

from spreadlake.llm import topk


@pytest.mark.parametrize("small", [False, True])
def test_odd_vectors(spark, monkeypatch, small):
    if small:
        for name, value in {"CANDIDATES": 16, "QUERIES": 5, "FIRST": 1, "BAND": 2, "TOGETHER": 3, "BYTES": 4000}.items():
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (3 if i % 11 == 0 else 1) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, [rng.gauss(0, 1) for _ in range(rng.choice((0, 2, 5, 9)))]) for i in range(60)]
    rows += [(400 + i, [rng.gauss(0, 1) * 2.0**21 for _ in range(6)]) for i in range(30)] + [(441 + i, [2.0**26 * (i + 1)] + [0.0] * 5) for i in range(3)]
    rows += [(400, rows[3][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = Counter()
    for q, x in ints:
        if q % 20 == 0:
            best = sorted(((sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in ints if i != q), key=lambda e: (-e[0], e[1]))[:7]
            want.update((q, k + 1, i, s) for k, (s, i) in enumerate(best))
    assert max(abs(w[3]) for w in want) > 2**53
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_only_empty_vectors(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0"), k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 0), (2, 2, 0)]


def test_low_scores(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [-1e30]), (2, [0.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0"), k=1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, df.where("vec_id = 0"), k=4).collect()
