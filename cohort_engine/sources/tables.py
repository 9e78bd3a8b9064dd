"""Table sources and sinks (S1-S4, S7-S9 plumbing).

Driver tables are parquet: we always ``select`` the needed columns right at
the scan so pruning and filter pushdown reach the reader.  CSV is supported
for report-style inputs with an explicit schema or all-string columns.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, cols=None) -> DataFrame:
    """Parquet driver table with the requested columns only."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Canonicalise NaN to NULL in floating columns (Spark orders NaN last and
    treats NaN > 0 as true, pandas treats NaN as missing)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "csv", null_values=(), header: bool = True, multiline: bool = False) -> DataFrame:
    """CSV (header, explicit schema or all strings) or parquet scan.

    ``null_values``: extra text tokens read as NULL; by default only blank is
    null, so a category literally named 'None' stays a value.  ``multiline``:
    cells may hold line ends; such files are not split.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        reader = spark.read.options(header=header, mode="PERMISSIVE", escape='"', multiLine=multiline)
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", False)
        df = reader.csv(path)
        for tok in null_values:
            df = df.select(*[
                (F.when(F.col(f.name) == F.lit(tok), F.lit(None).cast(f.dataType))
                 .otherwise(F.col(f.name))).alias(f.name)
                if f.dataType.simpleString() == "string" else F.col(f.name)
                for f in df.schema.fields])
    return nan_to_null(df)


def source_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    try:
        spark.read.format(fmt).load(path).schema  # noqa: B018 - resolves the path only
        return True
    except AnalysisException:
        return False


def read_optional(spark: SparkSession, path: str, schema: StructType,
                  fmt: str = "parquet") -> DataFrame:
    """Optional source: a missing path gives an empty table of ``schema``."""
    if not source_exists(spark, path, fmt):
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def require_sources(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> None:
    """Raise one FileNotFoundError naming every missing required source."""
    missing = [p for p in paths.values() if not source_exists(spark, p, fmt)]
    if missing:
        raise FileNotFoundError("Missing required files:\n" + "\n".join(missing))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    """Stage sink: parquet between stages, CSV (with header) for reports."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # quotes inside cells are doubled, blanks around text stay
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.format(fmt).save(path)
