"""Sources and sinks.

Reads declare their schema when one is given (no inference pass) and never
fail on a missing table: the caller gets a status row instead.  Writes go
to paths under a shared location (by default the session's checkpoint
folder, which a cluster points at shared storage), never to a machine-local
temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_REPORT = T.StructType([T.StructField("table", T.StringType()), T.StructField("path", T.StringType()),
                        T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    r = spark.read.format(fmt).options(**(options or {}))
    if fmt == "csv":
        r = r.option("header", "true").option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    elif fmt == "csv":
        r = r.option("inferSchema", "true")
    return r.load(path)


def load_modalities(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                    schemas: Mapping[str, T.StructType] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Read every named table; missing or unreadable ones are reported
    (status row) instead of failing.  Returns ``(tables, report)``."""
    tables, rows = {}, []
    for name, path in paths.items():
        try:
            df = read_table(spark, path, fmt, (schemas or {}).get(name))
            df.schema  # resolves the path; a missing one raises here
            tables[name] = df
            rows.append((name, path, "loaded", None))
        except AnalysisException as e:
            rows.append((name, path, "missing", str(e).split("\n")[0][:200]))
    return tables, spark.createDataFrame(rows, _REPORT)


def output_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh output folder under ``base`` (default: the shared checkpoint
    folder of the session)."""
    root = base or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/outputs/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a result table (parquet / csv / json), optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_metadata(stats: DataFrame, path: str, steps: list[str] | None = None) -> str:
    """S3: JSON metadata beside a dataset: the per-column statistics table
    plus the processing steps (one small JSON dataset, written by Spark)."""
    out = stats
    if steps is not None:
        out = out.withColumn("steps", F.array(*[F.lit(s) for s in steps]))
    out.coalesce(1).write.mode("overwrite").json(path)  # metadata is one row per column: small by construction
    return path


def sample_n(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """Reproducible sample of ``n`` rows: the n smallest
    ``xxhash64(key, seed)`` (a per-partition top-n, then a merge)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def verify_inventory(spark: SparkSession, expected: Mapping[str, str], key: Mapping[str, str] | None = None,
                     fmt: str = "parquet") -> DataFrame:
    """One row per expected table: exists / readable, rows, columns and
    distinct subjects (``key`` names the subject column per table)."""
    schema = T.StructType([T.StructField("table", T.StringType()), T.StructField("status", T.StringType()),
                           T.StructField("rows", T.LongType()), T.StructField("columns", T.IntegerType()),
                           T.StructField("subjects", T.LongType())])
    parts = []
    for name, path in expected.items():
        try:
            df = read_table(spark, path, fmt)
            k = (key or {}).get(name)
            aggs = [F.count(F.lit(1)).alias("rows"),
                    (F.count_distinct(k) if k else F.lit(None).cast("long")).alias("subjects")]
            parts.append(df.agg(*aggs).select(F.lit(name).alias("table"), F.lit("ok").alias("status"), "rows",
                                              F.lit(len(df.columns)).alias("columns"), "subjects"))
        except AnalysisException:
            parts.append(spark.createDataFrame([(name, "missing", None, None, None)], schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
