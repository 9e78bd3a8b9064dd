"""Tables written between the jobs of an operator.

Every operator that reads an intermediate result more than once writes it as
Parquet in the shared folder the session names (``spark.checkpoint.dir``), so
the lineage is cut, a lost executor re-reads files and no machine-local folder
is used on a cluster.  The shuffle files behind a written table go as soon as
it is written, the tables of a ``scratch`` block when the block ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from cohort_engine.llm import fsio
from cohort_engine.session import checkpoint_dir

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # else they stay until the driver collects its garbage
_INSIDE: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below the shared checkpoint folder."""
    return f"{_INSIDE.get() or checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator:
    """Tables ``written`` inside the block are deleted at its end, but for those
    written with the function it gives."""
    folder, outside = new_folder(spark, name), _INSIDE.get()
    token = _INSIDE.set(folder)

    def keep(df: DataFrame, kept: str) -> DataFrame:
        inner = _INSIDE.set(outside)
        try:
            return written(df, kept)
        finally:
            _INSIDE.reset(inner)
    try:
        yield keep
    finally:
        _INSIDE.reset(token)
        fsio.delete(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
