"""Near-duplicate vectors by random-hyperplane sign hashing.

Vectors that are equal byte for byte become one node with a count.  Every node
gets one code per table, the signs of its products with that table's random
hyperplanes.  Nodes that share a code in some table are compared by their exact
cosine; a pair is looked at in the first table that holds both, so links can be
counted without a list of pairs.  Links are joined to components in Spark.

The number of bits follows the number of nodes (a bucket holds few vectors by
chance), and the number of tables follows from the bits: a pair at the least
cosine shares a code in some table with probability ``RECALL`` or more.

Buckets with many nodes are cut into blocks; a task compares two blocks.  It
returns one row per node, its links' weight and the smallest node it hangs
together with there, never a row per pair.  A group of n vectors that differ
and all link takes n * n products, spread over its pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.llm.components import components
from cohort_engine.llm.store import written

LEAST_COSINE = 0.95
RECALL = 0.995                  # chance that a pair at the least cosine is compared
SPARE_BITS = 4                  # bits above log2 of the nodes
BLOCK_NODES = 1024
SEED = 20240611

_NODE = "node long, dim int, vec binary, codes binary"
_TILE = "node long, root long, weight long"


def shape(nodes: int, least: float = LEAST_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many nodes.  At the angle of ``least`` two signs
    agree with chance p, all bits of a table with p ** bits."""
    bits = min(max(1, math.ceil(math.log2(max(nodes, 2)))) + SPARE_BITS, 62)
    p = 1 - math.acos(least) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p ** bits)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def rows_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, row offsets) of a list column without nulls."""
    vecs = batch.column(column)
    offsets = np.asarray(vecs.offsets)
    return np.asarray(vecs.values, dtype=np.float64)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit print of each vector's values."""
    for batch in batches:
        flat, off = rows_of(batch, 1)
        flat = flat + 0.0                       # one zero
        prints = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), batch.column(1)],
                                         names=["vec_id", "print", "vec"])


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)        # squares can't overflow
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _coded(bits: int, tables: int):
    """Unit vectors with the codes of all tables."""
    power = (1 << np.arange(bits, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            flat, off = rows_of(batch, 1)
            dims = np.diff(off)
            for dim in np.unique(dims):
                dim = int(dim)
                if dim not in made:
                    made[dim] = planes(dim, bits, tables)
                own = np.flatnonzero(dims == dim)
                step = max(1, (1 << 22) // (tables * bits + dim))
                for at in range(0, len(own), step):
                    pick = own[at:at + step]
                    vec = unit(flat[off[pick][:, None] + np.arange(dim)])
                    codes = ((vec @ made[dim] >= 0).reshape(len(pick), tables, bits) @ power).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[pick], pa.int64()), pa.array(np.full(len(pick), dim, np.int32)),
                         pa.array([x.tobytes() for x in vec], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary())],
                        names=["node", "dim", "vec", "codes"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, table, code, node) for every table."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()])
        n, tables = codes.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(batch.column(1)), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
             pa.array(codes.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), tables))], names=["dim", "t", "code", "node"])


def linked(vec: np.ndarray, codes: np.ndarray, left: np.ndarray, table: int, least: float) -> np.ndarray:
    """Which pairs of a tile link here: row i with column j of the rows marked
    ``left`` with the others (with each other in a tile of one block), whose
    first common table this is."""
    n = len(vec)
    ok = vec @ vec.T >= least
    if left.any() and not left.all():
        ok &= left[:, None] != left[None, :]
    ok[np.arange(n), np.arange(n)] = False
    i, j = np.nonzero(ok)
    if table and len(i):
        for at in range(0, len(i), 1 << 16):            # a few pairs' codes at a time
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            ok[a, b] = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
    return ok


def roots(ok: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node that each row reaches by the links of the tile."""
    root = nodes.copy()
    i, j = np.nonzero(ok)
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        if (new == root).all():
            break
        root = new
    return root


def _tiles(least: float):
    """Rows sorted by tile; one tile at a time is held."""
    def work(rows: list[dict]) -> pa.RecordBatch | None:
        nodes = np.array([r["node"] for r in rows], np.int64)
        vec = np.stack([np.frombuffer(r["vec"], np.float64) for r in rows])
        codes = np.stack([np.frombuffer(r["codes"], np.int64) for r in rows])
        ok = linked(vec, codes, np.array([r["left"] for r in rows], bool), rows[0]["t"], least)
        some = ok.any(axis=1)
        if not some.any():
            return None
        weight = ok @ np.array([r["m"] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots(ok, nodes)[some]), pa.array(weight[some])],
                                          names=["node", "root", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        tile = None
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["dim"], r["t"], r["code"], r["i"], r["j"])
                if now != tile and held:
                    out = work(held)
                    if out is not None:
                        yield out
                    held = []
                tile = now
                held.append(r)
        if held:
            out = work(held)
            if out is not None:
                yield out
    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 least: float = LEAST_COSINE, recall: float = RECALL, block: int = BLOCK_NODES) -> DataFrame:
    """One row per row of ``vectors``: its id (as ``id_col``), n_links long (other
    rows whose cosine with it is ``least`` or more, of the pairs found),
    component_id long (smallest id reachable by links, its own included),
    kept boolean (it is the first of its component).

    Defined cases: vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without id, link with nothing (rows without
    id: component null, kept true); vectors of different lengths don't link;
    equal vectors always link; rows that repeat an id count as rows of their
    own; an empty table gives an empty result.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = every.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    prints = usable.mapInArrow(_prints, "vec_id long, print binary, vec array<double>")
    nodes = prints.groupBy("print").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    nodes = written(nodes, "vector-nodes")
    bits, tables = shape(nodes.count(), least, recall)
    coded = written(nodes.select("node", "vec").mapInArrow(_coded(bits, tables), _NODE), "vector-codes")

    keys = coded.select("node", "dim", "codes").mapInArrow(_keys, "dim int, t int, code long, node long")
    keys = written(keys, "vector-keys")
    buckets = (keys.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"))
               .filter("n > 1"))
    # The same nodes meet in many tables: the first stands for all.
    buckets = (buckets.groupBy("dim", "n", "mark").agg(F.min(F.struct("t", "code")).alias("at"))
               .select("dim", "at.t", "at.code", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int")
    rows = (keys.join(buckets, ["dim", "t", "code"]).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("dim", "t", "code", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    (F.col("own") <= F.col("other")).alias("left")))
    rows = (rows.join(coded.select("node", "vec", "codes").join(nodes.select("node", "m"), "node"), "node")
            .repartition("dim", "t", "code", "i", "j").sortWithinPartitions("dim", "t", "code", "i", "j"))
    tiles = written(rows.mapInArrow(_tiles(least), _TILE), "vector-links")

    found = components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    weights = tiles.groupBy("node").agg(F.sum("weight").alias("weight"))
    state = (nodes.select("print", "node", "m").join(weights, "node", "left").join(found, "node", "left")
             .select("print", (F.col("m") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "node").alias("component_id")))
    marked = prints.select("vec_id", "print").join(state, "print").select("vec_id", "n_links", "component_id")
    rest = (every.filter(F.col("vec_id").isNull() | F.col("vec").isNull() | F.coalesce(bad, F.lit(False))
                         | ~F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
            .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return (marked.unionByName(rest)
            .select(F.col("vec_id").alias(id_col), "n_links", "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
