"""Packing by the length histogram, shortest pack first (op5).

Every document becomes its ids and one closing id.  A document longer than a sequence is cut into
full sequences and a rest.  Lengths lie between 1 and the sequence length, so their histogram has a
fixed size however many documents there are; the driver packs the histogram alone: lengths longest
first, each into the shortest packs that have room (here the packs of a pattern move together), else
into new packs.  The patterns and their counts then join back to the pieces by a piece's rank among
the pieces of its length: a pattern's slot holds an interval of ranks.

Defined results: a null or empty text is the closing id alone, a piece of length 1; equal texts are
packed one by one; a row with a null id is packed like any other, its pieces without an id; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record, text_blocks, texts_of
from .bpe import byte_alphabet
from .shared import cut, with_offsets


def byte_ranks(path: str) -> dict[bytes, int]:
    """Each token's bytes and its id, from a JSON file of a byte-level vocabulary, whose merges must stand in the order of their ids, or from a file of ranks."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, merges, special = whole["model"]["vocab"], whole["model"]["merges"], {t["content"] for t in whole["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made):
        raise ValueError("merges are not in the order of their ids")
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}


class UnitTokenizer:
    """Byte-level ids by the unit: white space and the run after it, which no word of the split pattern crosses.

    Units seen before are looked up; the vocabulary's merges by rank make the rest.  A special string in a text is its id, as the library has it by default.
    """

    def __init__(self, rank_path: str, pattern: str, special: tuple[tuple[str, int], ...], keep_units: int = 500_000):
        import tiktoken

        ranks = byte_ranks(rank_path)
        self.coder = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = dict(special)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.units = re.compile(r"\s*\S+|\s+")
        self.separators = re.compile("[\x1c-\x1f]")  # white space to re, not to the pattern
        self.keep = keep_units
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        if self.separators.search(text):
            return np.array(self.coder.encode_ordinary(text), dtype="<u4").tobytes()
        units, known = self.units.findall(text), self.known
        new = list(set(units).difference(known))
        if new:
            code = self.coder.encode_ordinary
            for u in new:
                known[u] = np.array(code(u), dtype="<u4").tobytes()
        return b"".join([known[u] for u in units])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.keep:
            self.known.clear()
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))


@lru_cache(maxsize=2)
def _tokenizer(rank_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> UnitTokenizer:
    return UnitTokenizer(rank_path, pattern, special)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("local_rank", pa.int64())])


def pieces(docs: DataFrame, rank_path: str, pattern: str, special: tuple[tuple[str, int], ...], end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, with their rank among the pieces of their length in the same partition (``part``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(rank_path, pattern, special)
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for block in text_blocks(batch, "text"):
                rows = []
                for doc, text in zip(block.column("doc_id").to_pylist(), texts_of(block, "text"), strict=True):
                    ids = tok.encode(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]))
                        seen[length] += 1
                yield record(PIECES, *zip(*rows, strict=True))

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long")
    return made.withColumn("part", F.spark_partition_id())


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, with the number of packs that have them; every length is placed as often as it occurs.

    Of the packs with room the shortest take a length first, as many as there are, one each.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, ps in by_room.items() if ps and r >= length), default=None)
            if room is None:
                fit = min(left, size // length)  # a new pack stays the shortest with room until it is full
                many = left // fit
                by_room[size - fit * length][(length,) * fit] += many
                left -= fit * many
                continue
            pattern, have = next(iter(by_room[room].items()))
            used = min(left, have)
            if have == used:
                del by_room[room][pattern]
            else:
                by_room[room][pattern] = have - used
            by_room[room - length][(*pattern, length)] += used
            left -= used
    return [(p, n) for room in sorted(by_room) for p, n in sorted(by_room[room].items(), reverse=True)]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: the pack of an interval's first rank, and where the piece stands in its pack."""
    rows, used, pack = [], defaultdict(int), 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            rows.append((length, used[length], pack, at))
            used[length] += n
            at += length
        pack += n
    table = np.array(sorted(rows) or np.zeros((0, 4)), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "pack": table[:, 2], "offset": table[:, 3]}


PLACED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, rank_path: str, pattern: str, special: tuple[tuple[str, int], ...], end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    made = cut(pieces(docs, rank_path, pattern, special, end_id, size, id_col, text_col))
    counts = cut(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    # At most ``size`` rows reach the driver, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = made.sparkSession.sparkContext.broadcast(slot_table(pack_histogram(histogram, size)))
    offsets = with_offsets(counts, "length", "part", "n", "before")
    ranked = made.join(offsets.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("local_rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        bits = 40
        starts = (t["length"] << bits) + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, (length << bits) + rank, side="right") - 1
            yield record(PLACED, *(batch.column(c) for c in PIECES.names[:5]), t["pack"][at] + rank - t["rank"][at], t["offset"][at])

    return ranked.select(*PIECES.names[:5], "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
