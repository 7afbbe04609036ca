import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from spreadlake.llm import packing, tokens

TEXTS = ["", None, "Hello  World it's <|endoftext|> ok\n\tend ", " ", "a" * 3000, "0" * 90, "aaab" * 50, "ΣΑΣ Σ İ", "日本語 と é é", "x y\x1cz", "the " * 3000, "Hello  World it's <|endoftext|> ok\n\tend "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "other", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, part int")


def test_encode_and_decode(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokens.encode_digests(docs, P.path("word_bpe_49k.json")).collect()}
    back = {r["doc_id"]: r["decoded"] for r in tokens.decode(tokens.encode(docs, P.path("word_bpe_49k.json")), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and back[i] == text


def test_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, P.path("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)


def test_counts_do_not_depend_on_chunks():
    import random

    from spreadlake.llm.piece_dfa import from_sentencepiece

    dfa, rng = from_sentencepiece(P.path("piece_bpe_32k.model")), random.Random(5)
    pieces = list(dfa.score)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))).replace("▁", " ") for _ in range(60)]
    assert all((dfa.counts(texts, chunk=c) == dfa.counts(texts, chunk=1000)).all() for c in (1, 7, 64))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = 512
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, (("<|endoftext|>", 50256),), end_id=1, size=size).collect()
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        ids, at = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    assert sorted(packs) == list(range(len(packs)))
    for spans in packs.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size


def test_packing_histogram_places_everything():
    counts = {1: 1000, 7: 3, 100: 50, 1024: 5, 2048: 2, 1500: 9}
    placed = defaultdict(int)
    for pattern, n in packing.pack_histogram(counts, 2048):
        assert sum(pattern) <= 2048 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            placed[length] += n
    assert placed == counts


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert tokens.encode_digests(none, P.path("word_bpe_49k.json")).count() == 0
    assert tokens.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, (("<|endoftext|>", 50256),)).count() == 0


def test_ranks_of_both_files():
    assert packing.byte_ranks(P.path("byte_bpe_50k.json")) == packing.byte_ranks(P.path("byte_bpe_50k.tiktoken"))
