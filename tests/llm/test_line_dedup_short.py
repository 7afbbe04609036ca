"""op10 and the pipeline's stage on short lines: no floor under the number of words."""

import random

import __spark_entry__ as entry
import corpus_pipeline


def test_short_lines(spark, tmp_path):
    rng = random.Random(5)
    pool = ["All rights reserved.", "Read more", "Menu", "menu", "a b c d", "a b c e", "a b c", "d c b a", "x x x x x x x x", "x", "", " \t "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice("pqrstu") for _ in range(rng.randint(1, 7))) for _ in range(4)) for _ in range(60)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, gone = [], {i: [] for i in range(len(texts))}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = set(line.split())
            if w:
                if any(4 * len(w & s) >= 3 * len(w | s) for s in seen):
                    gone[i].append(k)
                seen.append(w)
    rows = entry.queries()["op10_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: [int(k) for k in r["removed"].split(",") if k] for r in rows} == gone
    assert all(r["n_removed"] == len(gone[r["doc_id"]]) and r["n_lines"] == len((texts[r["doc_id"]] or "").split("\n")) * (texts[r["doc_id"]] is not None) for r in rows)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()}
    cut = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)}
    assert left == {i: t for i, t in cut.items() if not gone[i] or t.split()}  # documents that lose all they said go
