"""op11 against a plain scan over windows, in one slice and in many; spans that go; awkward rows."""

import hashlib
import random
import re

import pytest

import __spark_entry__ as entry
from spreadlake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for n in range(1, width + 1):
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    named |= windows[tuple(w[at : at + n])]
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "x"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice((3, 9, 10, 11, 25, 40)))) for i in range(40)]
    items += [(None, text(15)), (3, text(20)), (77, None), (78, " .,; "), (79, "Long" + "g" * 700 + " " + text(12)), (80, items[5][1]), (81, items[6][1].upper())]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)]
    for k in range(40):
        i, t = rng.choice(items[:-2])
        w = (t or "").split()
        a = rng.randint(0, max(0, len(w) - 10))
        docs.append((100 + k, text(rng.randint(0, 15)) + ".\n" + "-".join(w[a : a + rng.choice((9, 10, 12, 40))]).title() + "; " + text(5)))
    docs += [(200, None), (201, ""), (202, " \x00\t--"), (None, items[2][1]), (203, items[-3][1]), (203, items[-3][1]), (204, text(30_000) + " " + items[9][1]), (205, "LONG" + "g" * 700)]
    return docs, items


@pytest.mark.parametrize("size", [32 << 20, 2000])
def test_report(spark, tmp_path, monkeypatch, rows, size):
    monkeypatch.setattr(decontaminate, "SLICE", size)
    docs, items = rows
    clashing = "cast(null as string) found, 1 as row, 2 as spans, 'z' as `a.b`, 3 as hash"
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *clashing.split(", ")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as key", "3 as item").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in entry.queries()["op11_decontamination"](spark, str(tmp_path)).collect()]
    want = expected(docs, items)
    assert sorted(got, key=repr) == want
    assert sum(r[5] for r in want) > 20 and any(r[3] > 1 for r in want)


def test_scan_and_remove_keep_columns(spark, rows):
    docs, items = rows
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "'k' as found", "1 as row", "text", "2 as spans", "3 as `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    with pytest.raises(ValueError, match="found"):
        decontaminate.scan(df, bench)
    out = decontaminate.remove(df, bench, most=0.5)
    assert out.columns == df.columns and out.schema["row"].dataType == df.schema["row"].dataType
    told = {i: (n, h) for i, n, h, *_ in expected(docs, items) if i is not None}
    left = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert set(left) == {i for i, (n, h) in told.items() if not n or h <= 0.5 * n}
    for i, text in docs:
        if i in left and not told[i][1]:
            assert left[i] == text
        elif i in left:
            assert len(words(left[i])) == told[i][0] - told[i][1]


def test_removed_span_leaves_the_rest(spark):
    passage = "one two three four five six seven eight nine ten"
    text = "Keep this.\nOne two, three four five six seven EIGHT nine ten! And this too, as it is no part of it."
    out = decontaminate.remove(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string"), most=0.9)
    assert out.first()["text"] == "Keep this.\n! And this too, as it is no part of it."


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(3, 0, 0, False), (0, 0, 0, False)]
