"""Exact top-k inner-product search by tiled matrix products.

Candidates are packed into row blocks, queries into tiles.  Each tile meets
each block once (an equi-join on the shard number, with the tiles replicated
to the shards), a numpy product gives the tile of scores, each query keeps its
k best of the tile, and the partial lists are merged in two levels (by query
and shard group, then by query).  Nothing passes through the driver and no
task holds more than one tile and one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_engine.llm.store import written

TILE_ROWS = 1024
BLOCK_ROWS = 4096
BLOCKS_PER_SHARD = 8
SCALE = 256.0
_EXACT = float(2**53)           # integers up to here are exact in a double

_BLOCK = "shard long, dim int, ids binary, data binary"
_PART = "query_id long, shard long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: id and vector present, every component finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad))


def _pack(rows: int, shards: int):
    """Arrow batches to blocks of at most ``rows`` integer vectors of one
    length; a block's shard number comes from its first id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            vecs = batch.column(1)
            offsets = np.asarray(vecs.offsets)
            flat = np.floor(np.asarray(vecs.values, dtype=np.float64) * SCALE)
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), rows):
                    pick = own[at:at + rows]
                    data = flat[(offsets[pick][:, None] + np.arange(dim)).ravel()] if dim else np.zeros(0)
                    shard = (int(ids[pick[0]]) * 0x9E3779B1 >> 7) % shards
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([int(dim)], pa.int32()),
                         pa.array([ids[pick].astype(np.int64).tobytes()], pa.binary()),
                         pa.array([data.astype(np.float64).tobytes()], pa.binary())],
                        names=["shard", "dim", "ids", "data"])
    return run


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64.  Doubles are exact below 2^53;
    larger values take Python integers, held to the range of a long."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(exact(q) @ exact(c).T, -2**63, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each row's k best, ties to the smaller id;
    columns whose id is the query's own are left out."""
    mine = own[:, None] == ids[None, :]
    low = np.iinfo(np.int64).min
    s = np.where(mine, low, scores)
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        rows, cols = np.nonzero((s >= least[:, None]) & ~mine)
    else:
        rows, cols = np.nonzero(~mine)
    order = np.lexsort((ids[cols], ~scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, cols = rows[rank < k], cols[rank < k]
    return rows, ids[cols], scores[rows, cols]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                dim = x["dim"]
                qi, ci = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                q = np.frombuffer(x["q_data"], np.float64).reshape(len(qi), dim)
                c = np.frombuffer(x["data"], np.float64).reshape(len(ci), dim)
                rows, ids, scores = best(products(q, c), ci, qi, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[rows]), pa.array(np.full(len(rows), x["shard"], np.int64)), pa.array(ids), pa.array(scores)],
                    names=["query_id", "shard", "vec_id", "score"])
    return run


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """Each query's k best candidates by the integer inner product of
    floor(256 * x): columns query_id, rank (from 1), vec_id, score.

    Defined cases: vectors that are null, hold a null or non-finite component,
    or lack an id take no part; vectors of different lengths never meet;
    candidates with the query's id are its own and left out; ties go to the
    smaller id; repeated candidate rows each count; a repeated query id is
    asked once (its smallest vector); fewer candidates than k give fewer rows;
    empty tables give an empty result.
    """
    cand = written(usable(candidates, id_col, vec_col), "topk-candidates")
    ask = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    n = cand.count()
    shards = max(1, math.ceil(n / (BLOCK_ROWS * BLOCKS_PER_SHARD)))
    blocks = cand.mapInArrow(_pack(BLOCK_ROWS, shards), _BLOCK)
    tiles = (ask.mapInArrow(_pack(TILE_ROWS, 1), _BLOCK)
             .select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")))
    parts = blocks.join(tiles, ["shard", "dim"]).mapInArrow(_search(k), _PART)
    fan = max(1, math.isqrt(shards))
    order = [F.col("score").desc(), F.col("vec_id")]
    near = Window.partitionBy("query_id", "part").orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    merged = (parts.withColumn("part", F.pmod("shard", F.lit(fan)))
              .withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k).drop("r", "part", "shard"))
    return (merged.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
