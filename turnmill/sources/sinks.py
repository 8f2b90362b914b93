"""Writing tables back: parquet folders, the input's own schema, replacement, and byte-exact JSON columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(path)


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in their order and types."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def replace(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then move it there; ``df`` may read from ``path``.

    The old table is moved aside first and deleted last, so that a whole copy exists at every moment.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    tmp = path.rstrip("/") + ".tmp"
    df.write.mode("overwrite").parquet(tmp)
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(tmp)
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot move {tmp} to {path}")
    fs.delete(aside, True)


def json_text(turns: Column) -> Column:
    """An array of turns as JSON; equal in value, not in bytes, as null fields are left out."""
    return F.to_json(turns)


def swap_roles_exact(column: str, where: Column) -> Column:
    """The JSON of ``column`` with user and assistant exchanged where ``where`` holds, all else byte for byte as it would be
    written with blanks after separators; other rows keep their string."""

    @F.pandas_udf(T.StringType())
    def swapped(s: pd.Series) -> pd.Series:
        other = {"user": "assistant", "assistant": "user"}

        def one(v):
            try:
                turns = json.loads(v) if v else None
            except ValueError:
                return v
            if not isinstance(turns, list):
                return v
            return json.dumps([{**t, "role": other.get(t["role"], t["role"])} if isinstance(t, dict) and isinstance(t.get("role"), str) else t for t in turns], ensure_ascii=False)

        return s.map(one)

    return F.when(where, swapped(F.when(where, F.col(column)))).otherwise(F.col(column))
