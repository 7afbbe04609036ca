"""op9: long runs that no synchronising bigram breaks, against the library, and within a time that no single lane would meet."""

import random
import time

import public_tokenizers as P
import pytest
import sentencepiece

from spreadlake.llm import piece_dfa

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return piece_dfa.from_sentencepiece(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def runs(n, seed=1):
    rng = random.Random(seed)
    return {
        "two letters": "ab" * (n // 2), "one letter": "a" * n, "random letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "dashes": "-" * n, "equals": "=" * n,
        "a word": "the" * (n // 3), "bases": "".join(rng.choice("acgt") for _ in range(n)), "parts": "".join(rng.choice(("in", "the", "er", "ation", "s", "est", "ing")) for _ in range(n // 3)),
    }


def test_runs_of_many_lengths(both):
    ours, lib = both
    texts = [x for n in (1_000, 1_030, 1_500, 2_049, 5_003) for x in runs(n, n).values()]
    texts += [f"Some words, then {x} and more words. {x}{x}" for x in runs(1_700, 5).values()] + ["x " * 900 + "ab" * 800 + "é" * 1_200 + "ab" * 900]
    assert ours.counts(texts).tolist() == [len(lib.encode(t)) for t in texts]


def test_small_pieces(both, monkeypatch):
    monkeypatch.setattr(piece_dfa, "LONG", 120)
    monkeypatch.setattr(piece_dfa, "PIECE", 64)
    ours, lib = both
    texts = [x[:k] for x in runs(700, 9).values() for k in (119, 121, 128, 129, 500, 700)]
    assert ours.counts(texts).tolist() == [len(lib.encode(t)) for t in texts]


@pytest.mark.parametrize("kind", ["two letters", "one letter", "dashes", "a word", "parts"])
def test_a_million_characters(both, kind):
    ours, lib = both
    text = runs(1_000_000)[kind]
    begin = time.process_time()
    got = ours.counts([text]).tolist()
    assert time.process_time() - begin < 5  # one lane took 25 seconds
    assert got == [len(lib.encode(text))]
