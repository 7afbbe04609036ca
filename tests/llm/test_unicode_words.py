"""op2 on characters that the library's Unicode version and Python's see differently."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spreadlake.llm.bpe import WordTokenizer


def test_newer_characters():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, rng = Tokenizer.from_file(path), WordTokenizer(path), random.Random(1)
    spans = [(0x20, 0x7F), (0x80, 0x250), (0x300, 0x590), (0x900, 0xE00), (0x1C80, 0x1D00), (0xA700, 0xA800), (0x10D40, 0x10D90), (0x11380, 0x113F0), (0x1F300, 0x1F700), (0x31350, 0x323B0)]
    texts = ["".join(rng.choice([" ", "\n", "'s", "ΑΣ", "<|endoftext|>"]) if rng.random() < 0.15 else chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for text, (ids, decoded) in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)
