"""op3: groups in as few shards as the quotas allow."""

from collections import Counter, defaultdict

import pytest

from spreadlake.llm import sharding


@pytest.mark.parametrize("free", [100, 0])
def test_groups_stay_together(spark, free):
    texts = ["third"] * 800 + ["one quota"] * 300 + ["more"] * 500 + [f"pair {i % (400 - free // 2)}" for i in range(800 - free)] + [f"free {i}" for i in range(free)]
    docs = spark.createDataFrame([(i * 7919 % 2400, t) for i, t in enumerate(texts)], "doc_id long, text string")
    text = {i * 7919 % 2400: t for i, t in enumerate(texts)}
    rows = sharding.shard(docs, shards=8).collect()
    assert Counter(r["shard"] for r in rows) == dict.fromkeys(range(8), 300) and len({r["doc_id"] for r in rows}) == 2400
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(300))
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert [len(where[t]) for t in ("third", "more", "one quota")] == [3, 2, 1]
    assert sum(len(where[t]) > 1 for t in where if t.startswith("pair")) <= 8
