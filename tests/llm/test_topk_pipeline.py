import math
import random

import pytest

from spreadlake.llm import topk


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + (i % 7 == 0)) for _ in range(20)], "x") for i in range(300)]
    rows += [(1000 + i, rows[5][1], "x") for i in range(30)]
    rows += [(2000, None, "x"), (2001, [None] + [1.0] * 19, "x"), (2002, [float("nan")] * 20, "x"), (2003, [float("inf")] * 20, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    vec = {r["vec_id"]: [math.floor(64 * x) for x in r["embedding"]] for r in df.where("vec_id < 2000").collect()}
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vec if i % 20 == 0}
    for q, rows_ in got.items():
        want = sorted(((sum(a * b for a, b in zip(vec[q], v, strict=True)), i) for i, v in vec.items() if i != q), key=lambda x: (-x[0], x[1]))[:6]
        assert sorted(rows_) == [(k + 1, i, s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    prose = [" ".join(rng.choice(vocab) for _ in range(40)) + "." for _ in range(12)]
    texts = [prose[0], prose[1] + "\na | b | c | d e f", prose[2] + "\n" + prose[0], prose[3], prose[3] + " extra", None, "", "too short", prose[4] + " mail a.b@mail1.example.com", *prose[5:], "spam " * 80]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {5, 6, 7, len(texts) - 1}.isdisjoint(left)  # rules: nothing, too little, repetition
    assert left[0] == prose[0] and left[1] == prose[1] and left[2] == prose[2]  # a failed line, a repeated one
    assert left[3] == prose[3] and 4 not in left  # its one line repeats another
    assert left[8].startswith(prose[4]) and "a.b@mail1" not in left[8]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(left)
