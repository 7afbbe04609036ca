"""The queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: the last ones depend on the order of sums."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the tables. In the SQL, R(x) rounds a double as ``rounded`` does and N(x) is count-like."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE[name] = oracle(_expand(sql))
        return f

    return register


def _expand(sql: str) -> str:
    """R(x) -> round(cast(x as double), 6) + 0.0; N(x) -> cast(x as bigint)."""
    out, i = [], 0
    for m in iter(lambda: re.compile(r"\b([RN])\(").search(sql, i), None):
        out.append(sql[i : m.start()])
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = _expand(sql[m.end() : j - 1])
        out.append(f"(round(cast({inner} as double), 6) + 0.0)" if m[1] == "R" else f"cast({inner} as bigint)")
        i = j
    return "".join([*out, sql[i:]])
