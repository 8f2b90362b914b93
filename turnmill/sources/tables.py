"""Parquet scans: one file, a folder of shards, or a named table of a data folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Every ``*.parquet`` below ``path`` (or ``path`` itself), as one DataFrame.

    Raises ``FileNotFoundError`` where nothing is found. With ``schema`` no footer is read for it.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if not path.rstrip("/").endswith(".parquet"):
        reader = reader.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no parquet files under {path}") from e
        raise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder with one ``NAME.parquet`` (file or folder) per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def concat_shards(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name; columns that a part lacks are null."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


def with_optional(df: DataFrame, name: str, default: Column) -> DataFrame:
    """``df`` itself where it has the column, else with ``default`` under that name."""
    return df if name in df.columns else df.withColumn(name, default)


def detect_format(df: DataFrame) -> str:
    """``sft`` where there are ``turns``, ``dpo`` where there are ``prompt`` and ``chosen``."""
    if "turns" in df.columns:
        return "sft"
    if {"prompt", "chosen"} <= set(df.columns):
        return "dpo"
    raise ValueError(f"neither turns nor prompt and chosen among {df.columns}")


def non_empty(df: DataFrame, what: str = "data set") -> DataFrame:
    """``df``, or ``ValueError`` where it has no row. Runs a job of one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty after filtering")
    return df


def shard_counts(df: DataFrame, kept: Column | None = None) -> DataFrame:
    """Rows per input file, by base name, and with ``kept`` those that it holds for. ``df`` must still carry ``_metadata``."""
    more = [] if kept is None else [F.count_if(kept).alias("kept")]
    return df.groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), *more)
