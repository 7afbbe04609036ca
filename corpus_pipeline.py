"""Corpus pipeline over ``documents``: quality rules, line dedup, n-gram Jaccard join, surrogates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a
DataFrame; all but the last return the columns of ``documents``, and columns beyond those too.  Stages are written
as Parquet and read again by whoever runs them.

Defined results: a null or empty text fails the quality rules.  A null id's lines neither go nor make others go, and it
is no copy of another document; its entities are replaced and it is packed.  Rows that repeat an id and a text are copies
of one another for lines at equal positions, which therefore stay; all rows of the id that a group keeps stay.  Texts are
taken whole, however long.  An empty table gives no rows at every stage.  Columns beyond those of documents stay, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.llm import line_dedup, packing, parity_join, quality, surrogates
from spreadlake.llm.shared import fresh, shared_folder

SURROGATE_KEY = b"corpus surrogates"  # a deployment passes its own secret


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines and rejected documents go; what has too few words goes too, so no document without text is left."""
    return _sized(quality.clean(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line go, and documents that have no word left after it: all they said stands in others."""
    return _sized(line_dedup.dedup(docs, drop_emptied=True))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays; of rows that repeat an id, all."""
    found = parity_join.jaccard_components(docs)
    stay = found.where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of theirs meets ours
    kept = rows.join(stay, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get their surrogates."""
    spans = fresh(docs.columns, "entities")
    return _sized(surrogates.pseudonymise(docs, SURROGATE_KEY, out=spans).drop(spans))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2,048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), end_id=1, size=2048)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("ngram_join", ngram_join), ("pii", pii), ("packing", pack)]

#: Surrogates are keyed hashes and pieces are ids of a tokenizer; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, the outcome of each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
