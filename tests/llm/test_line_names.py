"""op10: sets of words that share a name stay apart, and all results are as without."""

import random

from pyspark.sql import functions as F

from spreadlake.llm import line_dedup


def told(docs):
    return {r["doc_id"]: r["removed"] for r in line_dedup.report(docs).collect()}


def test_sets_that_share_names(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, "\n".join((f"only this {i} line stands here", "a line that all share", f"b{i} c{i}", *(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 7))) for _ in range(3))))) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1] + "\n" + "b7 c7 x"), (3, "another text of an id\na line that all share")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = told(docs)
    assert want[0] == [] and all(1 in want[i] for i in range(1, 30) if i != 3) and want[40] == list(range(6))
    ranked = line_dedup._ranked
    # All words hash alike: sets of one size share their first name.
    monkeypatch.setattr(line_dedup, "_ranked", lambda words, table: F.transform(ranked(words, table), lambda x: x.bitwiseAND(F.lit(0))))
    lines = line_dedup._lines(docs, bytes(line_dedup.BUCKETS), 3, 4, 1)
    assert lines.select("sid").distinct().count() <= 8 < lines.select("c").distinct().count()
    assert told(docs) == want


def test_word_order_and_repeats_make_one_set(spark):
    docs = spark.createDataFrame([(1, "b a a c"), (2, " c  b a"), (3, "\ta b c d e f g\r")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.report(docs).collect()} == {1: 0, 2: 1, 3: 0}
    assert line_dedup._lines(docs, bytes(line_dedup.BUCKETS), 3, 4, 1).select("c").distinct().count() == 2


def test_closeness_is_the_least_overlap(spark):
    """Any sketch distance that two sets can have: close if and only if the least overlap of similar sets allows it."""
    pairs = [(n, m, d) for n in range(1, 40) for m in range(1, 40) for d in range(abs(n - m) % 2, 40, 2)]
    rows = spark.createDataFrame([(n, m, (1 << d) - 1) for n, m, d in pairs], "n int, m int, s long")
    for p, q in ((3, 4), (1, 2), (9, 10)):
        a = rows.selectExpr("struct(n, 0L s0, 0L s1) a", "struct(m n, s s0, 0L s1) b")
        got = {(r["n"], r["m"], r["d"]) for r in a.where(line_dedup._close(p, q)).selectExpr("a.n n", "b.n m", "bit_count(b.s0) d").collect()}
        assert got == {(n, m, d) for n, m, d in pairs if min(n, m) * q >= max(n, m) * p and d <= n + m - 2 * -(-(n + m) * p // (p + q))}
