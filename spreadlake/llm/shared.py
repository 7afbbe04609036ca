"""What the operators of this subpackage have in common: written intermediates and offsets of dealt rows."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# While an intermediate is written: its shuffle files go at once, not when the driver happens to collect its garbage,
# and the driver keeps no long texts of its plan, which may hold a table as a literal.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}
SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session on one machine may go without: it gets a folder of its own. On a cluster that names
    none this is an error, as executors would write where others can't read.
    """
    context = spark.sparkContext
    if named := spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None):
        return named.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError(f"{SETTING} names no shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


#: For steps whose rows hold whole sets: Python gets few of them at a time.
LARGE_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def cut(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes an intermediate as Parquet to the shared folder and reads it, so that a lost executor costs no recomputation.

    As files, it has a known size: joins broadcast it only if Spark finds it small enough. settings: of the session while it is written.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    using = WRITING | (settings or {})
    before = {k: spark.conf.get(k, None) for k in using}
    try:
        for k, v in using.items():
            spark.conf.set(k, v)
        df.write.parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    return out


def drop(*written: DataFrame) -> None:
    """Removes what ``cut`` wrote, once nothing reads it any more, and lets the driver's JVM forget the plans that did."""
    gc.collect()
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_offsets(counts: DataFrame, key: str, part: str, n: str, offset: str) -> DataFrame:
    """Adds to one row per (key, part) the sum of n over the key's smaller parts."""
    from pyspark.sql import Window as W

    before = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(offset, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))
