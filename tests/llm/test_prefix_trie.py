"""op13 against a plain trie: shared first turns, copies, hot conversations in parts, awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from spreadlake.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - c % 20 if c >= 0 else c + -c % 20
        paths[c] = [t[2:] for t in own.get(donor, [])[:h] + turns[h:]]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if len(paths[c]) == len(node))
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(12)
    out = []
    lines = ["Hello there", "How are you\tall ?", "fine", "", None, "one two  three\nfour", "Grüße   und mehr"]
    for c in range(160):
        for turn in range(rng.choice((0, 1, 2, 3, 4, 6))):
            out.append((c, turn, rng.choice(("user", "assistant", None)), rng.choice(lines)))
    out += [(c, t, "user", f"same {t}") for c in range(200, 320) for t in range(5)]  # many copies
    out += [(400, t, "user", f"long {t % 7}") for t in range(500)]  # a conversation that holds a great share
    out += [(401, None, "user", "no turn"), (401, None, "a", "no turn"), (401, 3, "user", "x"), (401, 3, "user", "x"), (401, -1, "user", "first"), (402, 0, None, None)]  # nulls, ties, repeated rows
    out += [(-25, 0, "user", "below"), (-20, 0, "user", "donor"), (-20, 1, "user", "more"), (None, 0, "user", "nobody"), (2**62, 0, "user", "far"), (7, 0, "user", "ab"), (8, 0, "use", "rab")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(prefix_trie, "PART", 4)
        monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    said = rows()
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as at", "3 as part", "4 as x1", "5 as words")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["op13_prefix_trie"](spark, str(tmp_path))
    assert [f"{n} {t}" for n, t in got.dtypes] == [f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in COLUMNS]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(said)


def test_turnless_conversations(spark):
    # Shorter than h turns, and no donor: nothing is left of it but a member of the root.
    lone = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    said = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())] == expected(said)


def test_repeated_scan_of_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).count() == 0
