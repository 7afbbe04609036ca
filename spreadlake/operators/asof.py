"""As-of joins by a window over the union of both sides: one shuffle, no product of a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, day: str, forward: bool = False) -> DataFrame:
    """left with the last right row at or before ``at`` (forward: the first at or after); null where there is none."""
    taken = [c for c in right.columns if c not in keys]
    l = left.select(*keys, F.col(at).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*taken)).schema[0].dataType).alias("__r"))
    r = right.select(*keys, F.col(day).alias("__t"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*taken).alias("__r"))
    order = F.desc("__t") if forward else F.asc("__t")
    w = W.partitionBy(*keys).orderBy(order, F.col("__l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return both.select("__l.*", *[F.col(f"__m.{c}").alias(c) for c in taken if c not in left.columns])
