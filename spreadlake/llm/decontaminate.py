"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned against every window of the training texts (op11).

A-Z are lowered and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: ASCII digits, letters and all beyond ASCII.  A window is
``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.  The windows, distinct by
(window, item), are dealt by a hash into slices of at most SLICE bytes each, which are broadcast one after another; one slice
is the rule, as benchmarks are small, and then the texts are read once and nothing is shuffled.  A task hashes the words of its texts,
rolls window hashes over them, looks them up in the slice's sorted hashes, and verifies every hit on the words themselves (on
their SHA-256 if a window is longer than LONG bytes).  Hit windows become spans of words; with more than one slice a document
carries its spans and items on to the next.

Defined results: a null text has no words and no hits, an empty one likewise.  Rows that repeat an id are documents of their own.  A
benchmark row without words (or text) has no window; the windows of one with a null id hit, but name no item.  Rows that repeat an
item id are one item, its windows those of all its rows.  Texts are taken whole, however long.  An empty benchmark hits nothing and an empty
table gives no rows.  Other columns pass through ``scan`` and ``remove``, whatever their names; what these add is named by the caller.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import record, text_blocks
from .shared import cut
from .shingles import STEP, _hashed, mix

SLICE = 32 << 20  # bytes of windows, and of their items, that are broadcast at once
LONG = 512  # bytes from which a window is verified by its SHA-256
ENTRY = 24  # bytes of an entry besides its window

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True

WINDOWS = pa.schema([("hash", pa.int64()), ("words", pa.int32()), ("key", pa.binary()), ("item", pa.string())])
FOUND_TYPE = "struct<n_words:bigint,spans:array<struct<begin:bigint,end:bigint>>,items:array<string>>"


class Words:
    """The words of many texts: lowered bytes, spans, hashes and the text that each is in."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])] if size else np.zeros(0, dtype=np.uint8)
        self.first = offsets - offsets[0]
        self.data = data + ((data - 65 < 26) * np.uint8(32)).astype(np.uint8)  # uint8 wraps below 65
        inside = _LETTER[self.data]
        starts, stops = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        border = self.first[1:-1]
        border = border[(border > 0) & (border < size)]
        starts[border] = inside[border]
        stops[border - 1] = inside[border - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(self.first, self.start, side="right") - 1
        self.hash = _hashed(self.data, self.start, self.end) if len(self.start) else np.zeros(0, dtype=np.uint64)
        self.per_text = np.bincount(self.text, minlength=len(texts))

    def windows(self, width: int) -> np.ndarray:
        """The hash of the window that begins at each word; one that would pass the end of its text counts as none, see ``whole``."""
        n = max(0, len(self.hash) - width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            h = h * STEP + mix(self.hash[i : i + n], i + 1)
        return mix(h, width)

    def whole(self, at: np.ndarray, width: int) -> np.ndarray:
        """Those of the starts whose window lies within one text."""
        return at[self.text[at] == self.text[at + width - 1]]

    def key(self, at: int, width: int) -> bytes:
        """What a window is told by exactly: its words, or the SHA-256 of them if they are long."""
        text = b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[at : at + width].tolist(), self.end[at : at + width].tolist(), strict=True))
        return text if len(text) <= LONG else b"\x00" + hashlib.sha256(text).digest()


def benchmark_windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, words (of the window), key, item: the distinct windows of every item, the id as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                ids, words = block.column("item").to_pylist(), Words(block.column("text"))
                begin = np.concatenate([[0], np.cumsum(words.per_text)])
                rows = []
                by_width: dict[int, np.ndarray] = {}
                for i, n in enumerate(words.per_text.tolist()):
                    size = min(width, n)
                    if not size:
                        continue
                    if size not in by_width:
                        by_width[size] = words.windows(size).view(np.int64)
                    rows += [(int(by_width[size][at]), size, words.key(at, size), ids[i]) for at in range(int(begin[i]), int(begin[i]) + n - size + 1)]
                yield record(WINDOWS, *(zip(*rows, strict=True) if rows else ([], [], [], [])))

    found = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "hash long, words int, key binary, item string")
    return found.distinct()


class Slice:
    """A slice of the windows as a task uses it: sorted hashes by width, and what verifies them."""

    def __init__(self, rows: list):
        by_width: dict[int, set[int]] = defaultdict(set)
        self.entries: dict[tuple[int, bytes], list[str | None]] = defaultdict(list)
        for r in rows:
            by_width[r["words"]].add(r["hash"])
            self.entries[r["words"], bytes(r["key"])].append(r["item"])
        self.hashes = {w: np.sort(np.fromiter(h, dtype=np.int64, count=len(h))) for w, h in by_width.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of each verified window."""
        for width, known in self.hashes.items():
            got = words.windows(width).view(np.int64)
            place = np.minimum(np.searchsorted(known, got), len(known) - 1)
            for at in words.whole(np.flatnonzero(known[place] == got), width).tolist():
                items = self.entries.get((width, words.key(at, width)))
                if items is not None:
                    yield at, width, items


def _slices(windows: DataFrame) -> Iterator[list]:
    """The windows in slices of at most SLICE bytes; each reaches the driver alone, and a slice above the bound is parted further."""
    size = F.length("key") + F.coalesce(F.length("item"), F.lit(0)) + ENTRY
    total = windows.agg(F.sum(size).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // (SLICE // 2)) if total > SLICE else 1)
    while True:
        dealt = windows.withColumn("slice", F.pmod(F.xxhash64("key", "words", "item"), F.lit(parts)))
        if parts == 1 or dealt.groupBy("slice").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] <= SLICE:
            break
        parts *= 2
    for i in range(parts):
        yield dealt.where(F.col("slice") == i).select("hash", "words", "key", "item").collect()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of words without overlap; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _others(docs: DataFrame, text_col: str):
    """The columns but the text as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(True).alias("_row")).alias("row")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", out: str = "found", texts: bool = True) -> DataFrame:
    """Adds a struct: n_words, spans [begin, end) of hit words in order, items (ids as strings, sorted) whose windows occur.  texts: whether to keep the texts."""
    if out in docs.columns:
        raise ValueError(f"the documents have a column {out} already")
    spark = docs.sparkSession
    windows = cut(benchmark_windows(benchmark, width))
    packed = docs.select(_others(docs, text_col), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast(FOUND_TYPE).alias("found"))
    pieces = _slices(windows)
    piece = next(pieces)
    while piece is not None:
        after = next(pieces, None)
        with_text = texts or after is not None
        schema = packed.schema if with_text else T.StructType([f for f in packed.schema if f.name != "text"])
        packed = packed.mapInArrow(_scanner(spark.sparkContext.broadcast(Slice(piece)), with_text), schema)
        if after is not None:
            packed = cut(packed)  # one slice in a worker at a time
        piece = after
    row = F.col("row")
    return packed.select(*[F.col("text").alias(c) if c == text_col else row[c].alias(c) for c in docs.columns if texts or c != text_col], F.col("found").alias(out))


def _scanner(piece, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = Words(block.column("text"))
                begin = np.concatenate([[0], np.cumsum(words.per_text)])
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                if block.column("found").null_count < block.num_rows:
                    for i, b in enumerate(block.column("found").to_pylist()):
                        spans[i], items[i] = [(s["begin"], s["end"]) for s in b["spans"]], set(b["items"])
                for at, width, named in piece.value.hits(words):
                    i = int(words.text[at])
                    a = at - int(begin[i])
                    of = spans.setdefault(i, [])
                    if of and of[-1][0] <= a <= of[-1][1]:
                        of[-1] = (of[-1][0], max(of[-1][1], a + width))
                    else:
                        of.append((a, a + width))
                    items.setdefault(i, set()).update(x for x in named if x is not None)
                found = [{"n_words": n, "spans": [{"begin": a, "end": b} for a, b in _merged(spans.get(i, []))], "items": sorted(items.get(i, ()), key=lambda s: s.encode())} for i, n in enumerate(words.per_text.tolist())]
                columns = {"row": block.column("row"), "text": block.column("text"), "found": pa.array(found, type=block.schema.field("found").type)}
                yield pa.RecordBatch.from_pydict({c: v for c, v in columns.items() if with_text or c != "text"})

    return run


def _n_hit(found):
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words inside hit windows), n_items, items, spans, contaminated."""
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    f = F.col("found")
    told = scan(read, benchmark, width, texts=False).select("doc_id", f["n_words"].alias("n_words"), _n_hit(f).alias("n_hit"), f["items"].alias("items"), f["spans"].alias("spans"))
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents without hit spans: their words and what stands between them go; a document of which more than ``most`` of the words are hit goes as a whole.

    The columns stay as they are.  White space and signs around a span stay, so that what stood before and after it doesn't run together.
    """
    name = "found"
    while name in docs.columns:
        name += "_"
    f = F.col(f"`{name}`")
    found = scan(docs, benchmark, width, text_col, out=name)
    kept = found.where((f["n_words"] == 0) | (_n_hit(f) <= most * f["n_words"]))
    packed = kept.select(_others(docs, text_col), F.col(f"`{text_col}`").alias("text"), f["spans"].alias("spans"))
    cleaned = packed.mapInArrow(_without_spans, T.StructType([f for f in packed.schema if f.name != "spans"]))
    row = F.col("row")
    return cleaned.select(*[F.col("text").alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch, "text"):
            out = []
            for text, spans in zip(block.column("text").to_pylist(), block.column("spans").to_pylist(), strict=True):
                if spans:
                    words, raw, at, left = Words(pa.array([text], type=pa.large_string())), text.encode(), 0, []
                    for s in spans:
                        left.append(raw[at : int(words.start[s["begin"]])])
                        at = int(words.end[s["end"] - 1])
                    text = b"".join([*left, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_pydict({"row": block.column("row"), "text": pa.array(out, type=block.schema.field("text").type)})
