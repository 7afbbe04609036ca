"""The pipeline's stages keep columns of any name, also of names that operators use inside."""

import random

import pytest

NAMES = ("__id", "__q", "q", "__entities", "entities", "spans", "r", "row", "t", "__r", "__doc", "__gone", "__n", "__t", "id", "kept", "cleaned", "node", "sid", "found", "a.b", "h", "special", "component_id", "line_no", "removed")


def test_stages_keep_clashing_columns(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(400)]
    prose = [" ".join(rng.choice(vocab) for _ in range(40)) + "." for _ in range(8)]
    texts = [*prose, prose[0], prose[1] + " and a little more", "Dr. Anna Berger wrote to anna.berger@example.com. " + prose[2][:100] + " " + " ".join(vocab[:30]), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.selectExpr("*", *[f"concat('{n}-', doc_id) as `{n}`" for n in NAMES])
    for name, df in (("plain", plain), ("more", more)):
        df.write.parquet(f"{tmp_path}/{name}/0")
    for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
        out = {}
        for name in ("plain", "more"):
            docs = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            made = f(spark, docs, str(tmp_path))
            made.write.parquet(f"{tmp_path}/{name}/{k + 1}")
            out[name] = spark.read.parquet(f"{tmp_path}/{name}/{k + 1}")
        same = out["plain"].columns
        assert sorted(map(str, out["more"].select(*same).collect())) == sorted(map(str, out["plain"].collect())), stage
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out["more"].columns == more.columns, stage
            for r in out["more"].collect():
                assert all(r[n] == f"{n}-{r['doc_id']}" for n in NAMES), stage
        else:
            assert out["more"].columns == same
