"""Query registry: every registered query has a Spark builder
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, an
independent DuckDB oracle over the driver tables.

Computed floating columns listed in ``round6`` are rounded to 6 dp in both
the Spark result and the SQL text (with the same IEEE formula) so that value
hashes agree across engines despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    round6: tuple = field(default_factory=tuple)
    ids: str = ""  # SURVEY operator ids


REGISTRY: dict[str, Query] = {}


def round6(x):
    """6-dp half-up rounding as floor(x * 1e6 + 0.5) / 1e6: plain IEEE steps,
    so equal inputs round identically in Spark and in the SQL oracle (the
    engines' own round() differ on decimal ties)."""
    return F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def register(name: str, sql: str | None = None, round6=(), ids: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(round6), ids)
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q.build(spark, sf_dir)
        if q.round6:
            df = df.withColumns({c: round6(F.col(c)) for c in q.round6})
        return df
    run.__name__ = name
    return run


def oracle_text(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    if not q.round6:
        return q.sql.strip()
    repl = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS {c}"
                     for c in q.round6)
    return f"SELECT * REPLACE ({repl}) FROM (\n{q.sql.strip()}\n) AS q"
