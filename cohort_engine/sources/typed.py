"""Typed loads of text tables.

A report CSV is read once with every column as text; one aggregate per table
counts, per column, the non-blank cells, those that are integers (regex on
the trimmed text) and those that parse as doubles.  The type rule: all
non-blank cells integer (or no non-blank cell) -> INTEGER; all numeric ->
REAL; else TEXT.  Blank cells become NULL, text is trimmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohort_engine.functions.scalar import NUMBER_PATTERN, normalize_name
from cohort_engine.session import staged

INT_PATTERN = r"^[+-]?[0-9]+$"
# INTEGER columns beyond 64 bits are WIDE, beyond 38 digits TEXT: no value is lost.
SPARK_TYPES = {"INTEGER": "bigint", "WIDE": "decimal(38,0)", "REAL": "double", "TEXT": "string"}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case, '-' and ' ' to '_' (parentheses kept)."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    """A table as CSV text would carry it: every column a string, null as ''."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def infer_frame(df: DataFrame) -> DataFrame:
    """Per column (column, sql_type, non_blank) from one aggregate."""
    aggs = []
    for i, c in enumerate(df.columns):
        t = F.trim(F.col(c))
        nb = (t != F.lit("")) & t.isNotNull()
        aggs += [F.count(F.when(nb, 1)).alias(f"nb{i}"),
                 F.count(F.when(nb & t.rlike(INT_PATTERN), 1)).alias(f"ni{i}"),
                 F.count(F.when(nb & t.rlike(INT_PATTERN) & t.try_cast("bigint").isNotNull(), 1)).alias(f"nl{i}"),
                 F.count(F.when(nb & t.rlike(INT_PATTERN) & t.try_cast("decimal(38,0)").isNotNull(), 1)).alias(f"nw{i}"),
                 F.count(F.when(nb & t.rlike(NUMBER_PATTERN) & t.try_cast("double").isNotNull(), 1)).alias(f"nf{i}")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(df.columns):
        nb, ni, nf = F.col(f"nb{i}"), F.col(f"ni{i}"), F.col(f"nf{i}")
        whole = F.when(F.col(f"nl{i}") == nb, "INTEGER").when(F.col(f"nw{i}") == nb, "WIDE").otherwise("TEXT")
        typ = F.when(ni == nb, whole).when(nf == nb, F.lit("REAL")).otherwise(F.lit("TEXT"))
        structs.append(F.struct(F.lit(c).alias("column"), typ.alias("sql_type"), nb.alias("non_blank"),
                                F.lit(i).alias("ordinal")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def infer_types(df: DataFrame) -> dict[str, str]:
    """Fitted parameter: column -> INTEGER / REAL / TEXT."""
    return {r["column"]: r["sql_type"] for r in infer_frame(df).collect()}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Blank -> NULL, trimmed text, numeric casts per inferred type; columns
    without a type stay as they are."""
    out = []
    for c in df.columns:
        if c not in types:
            out.append(F.col(c))
            continue
        t = F.trim(F.col(c))
        v = F.when(t != F.lit(""), t)
        st = SPARK_TYPES[types[c]]
        out.append((v if st == "string" else v.try_cast(st)).alias(c))
    return df.select(*out)


def text_scan(spark: SparkSession, path: str, corrupt: str | None = None, multiline: bool = True) -> DataFrame:
    """A header CSV as text columns, quotes inside cells doubled.  ``corrupt``
    names one more column: the line of a row with too few or too many cells,
    else null (missing cells are null, further ones only stand there).
    ``multiline=False`` takes a line end as the end of a row also inside quotes;
    then large files are split."""
    head = spark.read.options(header=True, multiLine=multiline, escape='"', inferSchema=False).csv(path)
    names = head.columns
    schema = StructType([StructField(c, StringType()) for c in names] + ([StructField(corrupt, StringType())] if corrupt else []))
    reader = spark.read.schema(schema).options(header=True, multiLine=multiline, escape='"', mode="PERMISSIVE", enforceSchema=True)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.csv(path).toDF(*[c.strip() for c in names], *([corrupt] if corrupt else []))


def typed_load(spark: SparkSession, path: str, normalize: bool = False, multiline: bool = True,
               corrupt: str | None = None) -> DataFrame:
    """A header CSV with inferred types, names optionally normalised.

    The text is read once: it is written as a Parquet table in the shared
    folder, from which types are counted and rows returned.  (``observe`` would
    count during the write, but a session that has observed can't send a logistic
    model with its training summary to executors.)
    ``multiline`` and ``corrupt`` as in ``text_scan``.  A file without rows gives
    an empty table; columns without a cell that isn't blank are INTEGER."""
    df = text_scan(spark, path, corrupt, multiline)
    if normalize:
        names = normalize_columns(df).columns
        df = df.toDF(*(names[:-1] + [corrupt] if corrupt else names))
    cells = [c for c in df.columns if c != corrupt]
    kept = staged(df, "typed")
    types = infer_types(kept.select(*cells))
    return apply_types(kept, types)
