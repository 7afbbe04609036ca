"""op8: groups of near copies whose leaders aren't similar to all, parts of groups, null ids, long words, repeated rows."""

import random

import pyarrow as pa
import pytest

from spreadlake.llm import parity_join, shingles


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def find(x):
        return x if comp[x] == x else find(comp[x])

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize("unit", [4096, 8])
def test_chains(spark, monkeypatch, unit):
    """A text that changes word by word: each step is similar to the last, the ends are not; many families share a passage."""
    monkeypatch.setattr(parity_join, "UNIT", unit)
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(4):
        w = [rng.choice(vocab) for _ in range(60)]
        for _ in range(25):
            texts.append(" ".join(w))
            w[rng.randrange(60)] = rng.choice(vocab)
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40))) for _ in range(60)]
    texts += ["x" * 5000 + " b c d e f", "x" * 4999 + " b c d e f", "x" * 5000 + " b c d e f"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(df).collect()}
    assert got == brute(texts)


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, None), (3, text), (2, text), (2, text), (5, ""), (5, None), (6, "one two three four five six seven eight")]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (-1, 3, -1), (2, 3, 2), (2, 3, 2), (3, 3, 2), (5, 0, 5), (5, 0, 5), (6, 4, 2)]


def test_word_hashes():
    words = ["a", "b", "abcdefgh", "abcdefghi", "abcdefgha", "é", "x" * 255, "x" * 256, "x" * 257, "\0", "\0\0", "aB"]
    got, doc = shingles.word_hashes(pa.array([" ".join(words), None, "a\tAB", ""]))
    assert doc.tolist() == [0] * len(words) + [2, 2]
    assert len(set(got[: len(words)].tolist())) == len(words)
    assert got[len(words)] == got[0] and got[len(words) + 1] == got[len(words) - 1]
