"""A Parquet cache by fold: a fold is written anew without touching the others, and read alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import Files


class FoldCache:
    """Rows of one schema under ``folder``, a directory for each value of ``by``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, by: str = "fold"):
        self.spark, self.folder, self.schema, self.by = spark, folder.rstrip("/"), schema, by
        self.names = [f.name for f in schema if f.name != by]

    def write(self, df: DataFrame) -> None:
        """Replaces the folds that df has rows of, each as a whole; the others stay as they are."""
        rows = df.select(*self.names, self.by)
        rows.repartition(self.by, F.pmod(F.xxhash64(*self.names), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.folder)

    def read(self, folds: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the folds in the column ``by`` of another table: its rows decide, while the query runs, which directories are read."""
        if not Files(self.spark, self.folder).exists(self.folder):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.folder).select(*self.schema.names)
        return rows if folds is None else rows.join(folds.select(self.by).distinct(), self.by, "left_semi").select(*self.schema.names)

    def folds(self) -> list[str]:
        """The folds that are there, by their directories."""
        return [n.split("=", 1)[1] for n in Files(self.spark, self.folder).names(self.folder) if n.startswith(f"{self.by}=")]
