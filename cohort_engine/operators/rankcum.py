"""Running sums over a score order — the distributed replacement for a global
ordered window (which Spark plans on a single partition).

Input: one row per distinct (group..., score) with count columns (already
aggregated, so a hot score value is a single row).  Steps:

1. one shuffle: range partitions by (group..., score), sorted inside; a hot
   group spreads over partitions, equal scores are one row and stay together;
2. running sums inside each partition, a streaming pass over the sorted rows,
   written to the shared folder (partition numbers must not change after that);
3. per (group, partition) totals and their exclusive prefix sums: one row per
   group and partition that holds it;
4. the offset of its partition is added to every row.

Nothing is sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from cohort_engine.session import cut_lineage


def _starts(batch: pa.RecordBatch, groups: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows begin a group, and the last row's group."""
    cols = [batch.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for g in groups]
    new = np.zeros(batch.num_rows, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    key = lambda i: tuple(batch.column(g)[i].as_py() for g in groups)
    new[0] = before is None or key(0) != before
    return new, key(batch.num_rows - 1)


def _running(groups: Sequence[str], counts: Sequence[str], whole: Sequence[bool], with_next: bool):
    """Partition number, running sums since the group's first row here, and
    (``with_next``) the counts of the group's next row here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, carried, held = None, [0] * len(counts), None

        def done(batch: pa.RecordBatch, following: list | None) -> pa.RecordBatch:
            """The held batch; ``following``: the counts after its last row."""
            cols, names = list(batch.columns), list(batch.schema.names)
            if with_next:
                first = np.asarray(batch.column("__first"))
                for k, c in enumerate(counts):
                    v = batch.column(c).to_pylist()
                    nxt = [None if f else x for f, x in zip(first[1:], v[1:])] + [following[k] if following else None]
                    cols.append(pa.array(nxt, batch.column(c).type))
                    names.append(f"__next_{c}")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _starts(batch, groups, before)
            sums = []
            for k, c in enumerate(counts):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64 if whole[k] else np.float64)
                upto = np.cumsum(v)
                # what to take off: the sum before the row's group, less what
                # came with the group from earlier batches
                begin = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
                off = np.where(begin >= 0, upto[begin] - v[begin], -carried[k])
                sums.append(upto - off)
                carried[k] = sums[-1][-1]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(new), *[pa.array(s) for s in sums]],
                names=[*batch.schema.names, "__part", "__first", *[f"__run_{c}" for c in counts]])
            if held is not None:
                yield done(held, None if new[0] else [batch.column(c)[0].as_py() for c in counts])
            held, before = out, last
        if held is not None:
            yield done(held, None)
    return run


def cumulative(df: DataFrame, groups: Sequence[str], score: str, counts: Sequence[str], descending: bool = False,
               prefix: str = "cum_", with_next: bool = False, partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``counts`` (no nulls) in score order within
    each group; null groups are groups.  ``with_next=True`` also adds
    ``next_<c>``, the count of the following row in the same order (null on the
    last row), used by curve simplification."""
    groups, counts = list(groups), list(counts)
    order = [*[F.col(g) for g in groups], F.col(score).desc() if descending else F.col(score).asc()]
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = [not isinstance(types[c], DoubleType) for c in counts]
    extra = [StructField("__part", IntegerType()), StructField("__first", BooleanType())]
    extra += [StructField(f"__run_{c}", LongType() if w else DoubleType()) for c, w in zip(counts, whole)]
    extra += [StructField(f"__next_{c}", types[c]) for c in counts] if with_next else []
    placed = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .mapInArrow(_running(groups, counts, whole, with_next), StructType(df.schema.fields + extra)))

    aggs = [F.sum(c).alias(f"__t_{c}") for c in counts]
    aggs += [F.max(F.when(F.col("__first"), F.col(c))).alias(f"__f_{c}") for c in counts] if with_next else []
    by_part = Window.partitionBy(*groups).orderBy("__part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*groups, "__part").agg(*aggs).select(
        *groups, "__part", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in counts],
        *([F.lead(f"__f_{c}").over(by_part).alias(f"__n_{c}") for c in counts] if with_next else []))

    # A row per group and partition: AQE broadcasts it from its runtime size,
    # else sort-merge.
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in groups] + [F.col("d.__part") == F.col("o.__part")]
    mine = [F.col(f"o.{c}") for c in offsets.columns if c not in groups and c != "__part"]
    out = placed.alias("d").join(offsets.alias("o"), same).select("d.*", *mine)
    new = {f"{prefix}{c}": F.col(f"__run_{c}") + F.col(f"__o_{c}") for c in counts}
    if with_next:
        new |= {f"next_{c}": F.coalesce(F.col(f"__next_{c}"), F.col(f"__n_{c}")) for c in counts}
    return out.select(*df.columns, *[v.alias(k) for k, v in new.items()])
