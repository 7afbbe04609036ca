"""Token operators: pair-merge encoding and decoding (op2), and token counts (op9).

Rows: both return one row per input row.  A null text counts as an empty one, which has no
tokens; a null id stays null; repeated rows are answered one by one.  Columns other than the id
and the text are not read.  Texts are taken whole, in blocks of about 4 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record, text_blocks, texts_of
from .bpe import WordTokenizer
from .piece_dfa import PieceTransducer, from_sentencepiece


@lru_cache(maxsize=2)
def _word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def _transducer(path: str) -> PieceTransducer:
    return from_sentencepiece(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _pair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _word_tokenizer(tokenizer_path)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                got = tok.encode(texts_of(block, "text"))
                yield record(ENCODED, block.column("doc_id"), [a for a, _ in got], [b for _, b in got])

    return _pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of ``encode``, taken where the ids are made, so that neither ids nor texts leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _word_tokenizer(tokenizer_path)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                got = tok.encode(texts_of(block, "text"))
                yield record(DIGESTS, block.column("doc_id"), [len(a) // 4 for a, _ in got], [hashlib.sha256(a).hexdigest() for a, _ in got], [hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in got])

    return _pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded, from ids as ``encode`` gives them; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tok = _word_tokenizer(tokenizer_path)
        schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
        for batch in batches:
            yield record(schema, batch.column("doc_id"), [tok.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit by the compiled transducer of a piece model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = _transducer(model_path)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                size = pc.fill_null(pc.binary_length(block.column("text")), 0)
                yield record(COUNTS, block.column("doc_id"), size.cast(pa.int64()), dfa.counts(texts_of(block, "text")))

    out = _pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
