import random
import re
from collections import Counter, defaultdict

import pytest

from spreadlake.llm import line_dedup, parity_join, quality, sharding, surrogates, toxicity

SPACE = "[\x20\x09-\x0d]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 200]))) for _ in range(40)]
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    out = [None, "", " \n\t ", "one two", "ONE two", "É é", *base, *base[:10]]
    for b in base:
        for _ in range(3):
            w = b.split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    out += [shared + "\n" + " ".join(rng.choice(vocab) for _ in range(20)) for _ in range(25)]
    out += ["\n".join(rng.sample(base, 3)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(corpus())], "doc_id long, text string, node string, removed string")


def test_jaccard_components(spark, docs):
    sets = {}
    for i, t in enumerate(corpus()):
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        return x if comp[x] == x else find(comp[x])

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert parity_join.jaccard_components(docs.limit(0)).count() == 0


def test_line_dedup(spark, docs):
    gone, seen = defaultdict(list), []
    for i, t in enumerate(corpus()):
        for k, line in enumerate((t or "").split("\n")):
            w = set(words(line))
            if w:
                if any(4 * len(w & s) >= 3 * len(w | s) for s in seen):
                    gone[i].append(k)
                seen.append(w)
    rows = line_dedup.report(docs).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in rows} == {i: gone[i] for i in range(len(corpus()))}
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    for i, t in enumerate(corpus()):
        assert clean[i] == (t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
    assert line_dedup.report(docs.limit(0)).count() == 0 and line_dedup.dedup(docs).columns == docs.columns


def test_quality(spark):
    prose = "This is a plain line of prose with more than ten words in it."
    texts = [None, "", prose, prose + "\n" + "a | b | c | d", "x | y | z w v u t s r q p o n m", "again and again we say it " * 10, prose.replace(" ", "%%% "), prose + "\nAll rights reserved", prose + "\n" + prose + "\n \n \n"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r["q"] for r in quality.verdicts(df).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        again = {p + d for v in at.values() if len(v) > 1 for p in v for d in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (q["n_dup_lines"], q["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert q["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert [got[i]["kept"] for i in range(9)] == [False, False, True, True, False, False, False, True, False]
    kept = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    assert kept == {2: prose, 3: prose, 7: prose} and quality.clean(df).columns == df.columns
    assert quality.verdicts(df.limit(0)).count() == 0


def test_sharding(spark, docs):
    hot = docs.select("doc_id", "text").unionByName(spark.range(1000, 1120).selectExpr("id as doc_id", "'same' as text"))
    rows = sharding.shard(hot, shards=7).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(corpus()) + 120 and max(sizes.values()) - min(sizes[s] for s in range(7)) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert len({r["shard"] for r in rows if r["doc_id"] >= 1000}) < 7
    assert sharding.shard(docs.limit(0)).count() == 0


def test_surrogates(spark):
    text = "Ask Mrs Anna Berger at anna.b@mail.example.org or +1 (017) 555-7713, card 4845168114407329, not 7536784127813051, from 97.51.17.173; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mail anna.b@mail.example.org. Version 4.0."
    other = surrogates.surrogate("email", "anna.b@mail.example.org", b"k")
    df = spark.createDataFrame([(1, text, "e"), (2, None, "e"), (3, "", "e"), (4, f"write {other} now", "e"), (1, text, "e")], "doc_id long, text string, h string")
    rows = surrogates.pseudonymise(df, b"k").collect()
    new = next(r["text"] for r in rows if r["doc_id"] == 1)
    for secret in ("Anna Berger", "anna.b@", "555-7713", "4845168114407329", "97.51.17.173", "04dbebab"):
        assert secret not in new
    assert "7536784127813051" in new and "Mrs " in new and "Version 4.0." in new
    mails = re.findall(r"[\w.]+@[\w.]+\w", new)
    assert len(mails) == 2 and len(set(mails)) == 1 and mails[0] != other
    assert surrogates.check_sum(re.search(r"card (\d{16})", new)[1]) == 0
    fourth = next(r["text"] for r in rows if r["doc_id"] == 4)
    assert other not in fourth and mails[0] not in fourth
    assert {r["doc_id"]: r["text"] for r in rows}[2] is None and {r["doc_id"]: r["text"] for r in rows}[3] == ""
    assert len({surrogates.surrogate("phone", f"{i:04d}", b"k") for i in range(10_000)}) == 10_000


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 30)
        hits = [(i, rng.uniform(0.1, 3)) for i in range(n) if rng.random() < 0.4]
        values = [-0.5] * n
        for i, s in hits:
            values[i] = s
        got = toxicity.maximal_segments(hits, 0.5)
        best = max((sum(values[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert (max((s for *_, s in got), default=None) or best) == pytest.approx(best)
        for a, b, s in got:
            assert s == pytest.approx(sum(values[a:b])) and all(sum(values[a:k]) > 0 for k in range(a + 1, b + 1))


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    good, bad = [f"w{i}" for i in range(300)], ["scum", "idiot", "moron"]
    rows, labels = [(9_000, None), (9_001, "")], [(9_000, None)]
    for i in range(600):
        w = [rng.choice(good) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_passages(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600)) and got[9_000] < 0.5 and got[9_001] < 0.5
    none = toxicity.train(docs, marks.limit(0))
    assert {round(r["score"], 6) for r in toxicity.toxic_passages(docs, none).collect()} == {0.0}
