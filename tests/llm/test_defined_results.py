"""Every registered query over one small table of awkward rows: null ids, null, empty and very long texts, repeated rows, clashing columns; and over an empty one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = "Plain prose of more than ten words stands here, so that rules let it pass. "


def texts():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(300)]
    out = [None, "", " \t\n", "one", LONG, LONG + " tail", PROSE, PROSE, PROSE + "More.\nAll rights reserved", "a | b | c", "Ask Mr Wu or Dr Anna Berger. Berger nods.", "ǅ ß İ ſ ՘ \U00011380 x̸", "<|endoftext|> [PAD]"]
    for _ in range(60):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))))
    out += [out[-1]] * 3 + [out[-2] + " x", out[-2] + " y"]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, PROSE), (None, None), (6, PROSE), (20, rows[20][1])]  # null ids, a repeated row, an id that two rows share
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    clashing = "node string, shard int, slot long, kept boolean, rank int, q string, r string, removed string, entities string"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in clashing.split(", "):
        df = df.selectExpr("*", f"cast(null as {c.split()[1]}) {c.split()[0]}")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(70)] + [(None, 1, 1), (5, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, table):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{table[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    for name, schema in {"embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


QUERIES = sorted(n for n in entry.queries() if re.match(r"op\d+_|pipeline", n))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == 0


def run(spark, table, name):
    return [r.asDict() for r in entry.queries()[name](spark, table[0]).collect()]


def keyed(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def test_op2(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation(), lib.no_padding()
    want = Counter()
    for i, t, *_ in table[1]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert keyed(run(spark, table, "op2_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op3(spark, table):
    rows = run(spark, table, "op3_sharding")
    raw = [(t or "").encode() for _, t, *_ in table[1]]
    assert keyed(rows, "doc_id", "size", "text_crc32") == Counter((r[0], len(b) + 16, zlib.crc32(b)) for r, b in zip(table[1], raw, strict=True))
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op4(spark, table):
    got = keyed(run(spark, table, "op4_quality"), "doc_id", "n_words", "word_chars")
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    assert got == Counter((i, len(words(t)), sum(map(len, words(t)))) for i, t, *_ in table[1])


def test_op5(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.no_truncation(), lib.no_padding()
    want = Counter(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in table[1])
    rows = run(spark, table, "op5_packing")
    assert Counter(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    tokens = sum(k * n for k, n in want.items())
    padded = sum(2048 - n if n & (n - 1) else 0 for n in (max(o + k for o, k in p) for p in used.values()))
    assert padded <= 2048 and len(used) <= math.ceil(tokens / 2048) + 11  # little padding, and sequences at powers of two


def test_op6(spark, table):
    rows = run(spark, table, "op6_toxicity")
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in table[1])
    of = dict()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        of.setdefault(r["doc_id"], set()).add(r["score"])
    assert of[0] == of[1] == of[2]  # no words: no evidence


def test_op7(spark, table):
    rows = run(spark, table, "op7_pii")
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in table[1])
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[0] is None and by[1] == "" and by[4] == LONG and by[5] == LONG + " tail"
    first, last, again = re.fullmatch(r"Ask Mr \w+ or Dr (\w+) (\w+)\. (\w+) nods\.", by[10]).groups()
    assert last == again and not {first, last} & {"Anna", "Berger"}


def test_op8(spark, table):
    rows = run(spark, table, "op8_ngram_join")
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in table[1])
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[5][1] == by[4][1] == 4 and by[7][1] == by[6][1] == 6


def test_op9(spark, table):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t, *_ in table[1])
    assert keyed(run(spark, table, "op9_token_counts"), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_op10(spark, table):
    rows = run(spark, table, "op10_line_dedup")
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in table[1])
    by = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in rows if r["doc_id"] is not None}
    assert by[0] == (0, "") and by[1] == (1, "") and by[4] == (1, "") and by[5] == (1, "0") and by[7] == (1, "0")
    assert all(r["removed"] == "" for r in rows if r["doc_id"] is None)


def test_pipeline_stages(spark, table, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, table[0])
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert {0, 1, 2, 3}.isdisjoint(ids) and None in ids, name  # nothing to keep; a null id's prose stays
    left = [r["doc_id"] for r in docs.collect()]
    assert 6 in left and 7 not in left and 5 not in left  # a later copy, and what differs by a word
    rows = corpus_pipeline.run(spark, table[0]).collect()
    assert {r["doc_id"] for r in rows} == set(left)


def test_op1(spark, tmp_path):
    from spreadlake.llm import topk

    rows = [(i, [float(i % 7), float(-i % 5), 1.0]) for i in range(60)] + [(20, [3.0, 1.0, 2.0]), (7, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(100, [1e9, 0.0, 0.0]), (120, [1.0, 2.0]), (140, None), (160, []), (180, [float("inf"), 0.0, 0.0]), (200, [2.0, 1.0, 0.5, -3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    part = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(map(math.isfinite, v))]
    want = Counter()
    for q, x in part:
        if q % 20 == 0:
            best = sorted(((sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in part if i != q), key=lambda e: (-e[0], e[1]))[:20]
            want.update((q, k + 1, i, s) for k, (s, i) in enumerate(best))
    got = entry.queries()["op1_topk_search"](spark, str(tmp_path)).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    huge = df.unionByName(spark.createDataFrame([(220, [1e30, 0.0, 0.0], 0)], df.schema))
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(huge, huge.where("vec_id % 20 = 0")).collect()
    few = topk.top_k(df.where("vec_id < 5"), df.where("vec_id = 0"), k=20).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] and len(few) == 4
