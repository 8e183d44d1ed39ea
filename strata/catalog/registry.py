"""Registry of benchmark queries: name -> (spark callable, DuckDB oracle SQL).

Every registered query reads the benchmark tables under ``sf_dir`` whole;
outputs round doubles to 6 decimals so that engine-level float noise does
not change the value hash (the oracle SQL rounds the same way).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return dates_as_text(fn(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def dates_as_text(df: DataFrame) -> DataFrame:
    """DATE columns as ISO text, so both engines hand identical values to
    the comparison (timestamps are left as they are)."""
    if not any(isinstance(f.dataType, T.DateType) for f in df.schema.fields):
        return df
    return df.select([F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType)
                      else F.col(f.name) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double / float column (also inside arrays)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            cols.append(F.transform(F.col(f.name), lambda x: F.round(x.cast("double"), digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def quick_round(c: Column, digits: int = 6) -> Column:
    """``F.round`` of doubles, with the same values, for results of very many
    rows: decimal arithmetic only where a value may lie halfway or is large."""
    scaled = c * 10.0 ** digits
    plain = (F.abs(c) < 10.0 ** (9 - digits)) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(plain, F.floor(scaled + 0.5).cast("double") / 10.0 ** digits).otherwise(F.round(c, digits))
