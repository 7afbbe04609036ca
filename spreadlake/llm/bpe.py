"""Pair-merge encoding of many words at once through a pair occurrence index, and its inverse.

The words of a block lie one after the other in arrays of symbols with links to their
neighbours.  The index maps every pair with a rank to all its positions in the block; the
active ranks are applied in ascending order, each at all its positions together, and the pairs
that a merge makes are entered in their own lists.  The order is that of merging each word on
its own as long as no merge needs a symbol that a later merge makes, which is checked.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Regex, Tokenizer, normalizers


def byte_alphabet() -> list[str]:
    """The usual printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(extra))
        extra += b not in keep
    return out


class PairIndexEncoder:
    """Merges over bytes; ``suffix`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.size = max(vocab.values()) + 1
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        made = np.full(self.size, -1, dtype=np.int64)
        made[self.joined[::-1]] = np.arange(len(merges))[::-1]
        rank = np.arange(len(merges))
        if ((made[left] >= rank) | (made[right] >= rank)).any():
            raise ValueError("a merge needs a symbol that a later merge makes")
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where a pair has none."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all words, one after the other, and where each word's end; an empty word has none."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, dtype="<u4"), [0] * len(words)
        sym = self.inner[raw]
        full = lengths > 0
        tails, heads = (ends - 1)[full], (ends - lengths)[full]
        sym[tails] = self.last[raw[tails]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[tails], prv[heads] = n, -1
        sym = np.append(sym, -1)  # what stands after the last symbol of a word
        nxt, prv = np.append(nxt, n), np.append(prv, -1)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            positions = positions[nxt[positions] < n]
            rank = self.ranks(sym[positions], sym[nxt[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            firsts = rank[np.concatenate([[0], cuts])].tolist()
            for r, at in zip(firsts, np.split(positions, cuts) if len(cuts) else [positions], strict=True):
                if r in lists:
                    lists[r].append(at)
                else:
                    lists[r] = [at]
                    heapq.heappush(active, r)

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = lists.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if not len(at):
                continue
            if a == b:  # of overlapping occurrences the leftmost goes first
                at = np.sort(at)
                new = np.ones(len(at), dtype=bool)
                new[1:] = nxt[at[:-1]] != at[1:]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.joined[r], -1
            nxt[at] = after
            prv[after] = np.where(after < n, at, prv[after])
            before = prv[at]
            enter(np.unique(np.concatenate([at, before[before >= 0]])))
        live = sym[:n] >= 0
        ids = sym[:n][live].astype("<u4")
        stop = np.concatenate([[0], np.cumsum(live)])[ends]
        return ids, stop.tolist()


NOTHING = (b"", "")
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def _ranges(points: list[int]) -> str:
    """A character class of ascending code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


def odd_characters(normalizer: normalizers.Normalizer) -> re.Pattern | None:
    """Characters that the library and Python, whose Unicode versions differ, class, compose or lower-case differently, or that Python doesn't know."""
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i) not in "|\x01"]
    text = "".join(chars)
    odd = {c for c in chars if unicodedata.category(c) == "Cn"}
    for name in CLASSES:
        pairs = zip(chars, normalizers.Replace(Regex(name), "\x01").normalize_str(text), regex.sub(name, "\x01", text), strict=True)
        odd.update(c for c, a, b in pairs if a != b)
    pairs = zip(chars, normalizer.normalize_str("|".join(chars)).split("|"), strict=True)
    odd.update(c for c, a in pairs if a != _normal(c) and not c.isspace())
    return re.compile(_ranges(sorted(map(ord, odd)))) if odd else None


def _normal(text: str) -> str:
    """Composed and lower-cased letter by letter, without the rule for a final sigma."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordTokenizer:
    """The tokenizer of a ``tokenizers`` JSON file with lower-cased, byte-level words: texts to ids and back.

    Added tokens that a text contains are taken as such before anything else, as the library does by default.  A chunk
    with a character that the library's Unicode version sees differently is parted into words by the library.
    """

    def __init__(self, path: str, keep_words: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.encoder = PairIndexEncoder(vocab, [tuple(m) for m in model["merges"]], suffix)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.lower = any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.runs, self.separators = regex.compile(r"[^\s]+"), re.compile("[\x1c-\x1f]")  # str.split() also parts at these
        self.names = {i: s for s, i in (vocab | self.added).items()}
        self.library = Tokenizer.from_file(path)
        self.odd = odd_characters(self.library.normalizer) if self.lower else None
        self.keep = keep_words
        self.known: dict[str, tuple[bytes, str]] = {}  # of a chunk: ids, decoded

    def _chunks(self, text: str) -> list[str]:
        """Runs without white space, and added tokens behind a space; no word reaches over white space."""
        if self.split_added and "<|" in text:
            parts = self.split_added.split(text)
            return [w for i, p in enumerate(parts) for w in ([" " + p] if i % 2 else self._runs(p))]
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        return self.runs.findall(text) if self.separators.search(text) else text.split()

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.words.findall(chunk.lower() if self.lower else chunk)
        if self.odd and self.odd.search(chunk):
            text = self.library.normalizer.normalize_str(chunk)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(_normal(chunk) if self.lower else unicodedata.normalize("NFC", chunk))

    def learn(self, chunks: list[list[str]]) -> None:
        """Encodes the words of a block's chunks that are not known yet, all together."""
        if len(self.known) > self.keep:
            self.known.clear()
        new = list({c for cs in chunks for c in cs}.difference(self.known))
        words = [self._words(c) if c[0] != " " else [] for c in new]
        distinct = list({w for ws in words for w in ws})
        ids, stops = self.encoder.encode([w.encode("utf-8") for w in distinct])
        raw, names = ids.tobytes(), [self.names[i] for i in ids.tolist()]
        of, at = {}, 0
        for w, to in zip(distinct, stops, strict=True):
            of[w] = raw[4 * at : 4 * to], " ".join(names[at:to])
            at = to
        known = self.known
        for c, ws in zip(new, words, strict=True):
            if len(ws) == 1:
                known[c] = of[ws[0]]
            elif ws:
                known[c] = b"".join([of[w][0] for w in ws]), " ".join([of[w][1] for w in ws])
            else:
                known[c] = (np.array([self.added[c[1:]]], dtype="<u4").tobytes(), c[1:]) if c[0] == " " else NOTHING

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids where the file names no decoder: the tokens with spaces between."""
        return " ".join([self.names[i] for i in ids.tolist()])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        chunks = [self._chunks(t) for t in texts]
        self.learn(chunks)
        known, out = self.known, []
        for cs in chunks:
            got = [known[c] for c in cs]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out
