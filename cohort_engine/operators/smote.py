"""Synthetic minority oversampling (R3): exact nearest neighbours inside a
class, then points between a row and one of its neighbours.

The rows of each class are ordered along a Hilbert curve through their widest
features and packed into blocks, each with the box around its rows.  A row meets
its own block, and of the others those whose box is no farther than its k-th
distance inside the own block.  A task compares such rows with a block: a matrix
product finds the near pairs, their distances are then summed feature by
feature.  Each pair of blocks gives at most k rows per row; partial lists are
merged by key.  What reaches the driver and the tasks of all blocks is one row
per block: its box and its largest k-th distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_engine.operators.sampling import class_counts, hash_digits, hash_int, rank_within, seeded_hash
from cohort_engine.session import cut_lineage

NEIGHBOURS = 5                  # fixed value: the neighbours a synthetic row may lean to
BLOCK_ROWS = 2048
QUERY_ROWS = 256                # rows of a block compared with another block at a time
SENT_ROWS = 16                  # blocks a task passes on at a time
SHARES_A_TASK = 8
CURVE_AXES, CURVE_BITS = 5, 60  # features of the curve, bits of a place on it
_HASH_RANGE = float(2**60)      # fifteen hex digits

_BLOCK = "cls string, block long, lo array<double>, hi array<double>, reach double, bound binary, ids binary, data binary"
_TILE = "cls string, key long, neighbour long, distance2 double"


def usable(df: DataFrame, label: str, key: str, features: Sequence[str]) -> DataFrame:
    """cls, key, x of the rows that can have neighbours: label and key present,
    all features finite."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return (df.select(F.col(label).cast("string").alias("cls"), F.col(key).cast("long").alias("key"), x.alias("x"))
            .filter(F.col("cls").isNotNull() & F.col("key").isNotNull() & ~bad))


def nearest(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, squared distance) of each query's k nearest
    candidates but itself; ties to the smaller id.  ``QUERY_ROWS`` queries are
    compared at a time."""
    parts = [_nearest(q[at:at + QUERY_ROWS], qi[at:at + QUERY_ROWS], c, ci, k) for at in range(0, max(len(q), 1), QUERY_ROWS)]
    return (np.concatenate([p[0] + n * QUERY_ROWS for n, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]),
            np.concatenate([p[2] for p in parts]))


def _nearest(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sq, sc = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    rough = sq[:, None] + sc[None, :] - 2 * (q @ c.T)
    own = qi[:, None] == ci[None, :]
    rough[own] = np.inf
    if rough.shape[1] > k:
        slack = 1e-12 * q.shape[1] * (sq[:, None] + sc.max())        # far above the rounding of the product
        near = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1:k] + 2 * slack
        near &= ~own
    else:
        near = ~own
    i, j = np.nonzero(near)
    d = np.zeros(len(i))
    for f in range(q.shape[1]):
        gap = q[i, f] - c[j, f]
        d += gap * gap
    order = np.lexsort((ci[j], d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], ci[j[rank < k]], d[rank < k]


def _apart(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of boxes."""
    gap = np.maximum(np.maximum(lo - high, low - hi), 0.0)
    return np.einsum("...j,...j->...", gap, gap)


def nearest_within(q: np.ndarray, qi: np.ndarray, bound: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``nearest``, of the candidates no farther than the query's ``bound``.
    ``QUERY_ROWS`` candidates, which lie near each other, are compared with the
    queries that reach the box around them."""
    parts = []
    for at in range(0, len(c), QUERY_ROWS):
        own = c[at:at + QUERY_ROWS]
        rows = np.flatnonzero(_apart(q, q, own.min(axis=0), own.max(axis=0)) <= bound * (1 + 1e-9))
        if len(rows):
            i, other, d = nearest(q[rows], qi[rows], own, ci[at:at + QUERY_ROWS], k)
            near = d <= bound[rows[i]]
            parts.append((rows[i[near]], other[near], d[near]))
    i, other, d = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((other, d, i))
    i, other, d = i[order], other[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], other[rank < k], d[rank < k]


def kth_distances(data: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of each row to its k-th neighbour among the rows; inf
    where there are fewer.  The rows around it give a first bound."""
    def kth(i: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.inf)
        full = np.flatnonzero(np.bincount(i, minlength=n) == k)
        out[full] = d[np.searchsorted(i, full, "right") - 1]
        return out
    bound = np.full(len(ids), np.inf)
    for at in range(0, len(ids), QUERY_ROWS):
        own, mine = data[at:at + QUERY_ROWS], ids[at:at + QUERY_ROWS]
        i, _, d = nearest(own, mine, own, mine, k)
        bound[at:at + QUERY_ROWS] = kth(i, d, len(mine))
    i, _, d = nearest_within(data, ids, bound, data, ids, k)
    return kth(i, d, len(ids))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2 ** bits) on the Hilbert
    curve (Skilling, 2004)."""
    x = [c.astype(np.int64) for c in cells.T]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = x[0] ^ np.where(x[i] & q, q - 1, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    out = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b) & 1
    return out


def _placed(axes: Sequence[int], middle: Sequence[float], sd: float):
    """The rows and their place on the curve through four deviations around the
    middle; farther values lie on the border."""
    bits = CURVE_BITS // max(len(axes), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1)[:, list(axes)]
            cells = np.clip((x / sd - np.array(middle) / sd + 4) * 2.0 ** (bits - 3), 0, 2 ** bits - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, bits))], names=["cls", "key", "x", "place"])
    return run


def _pack(rows: int, k: int):
    """Rows sorted by class and place to blocks; ``reach``: the largest distance
    to a k-th neighbour inside the block."""
    def block(cls: str, number: int, held: list) -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], np.int64)
        data = np.array([h[1] for h in held], np.float64)
        bound = kth_distances(data, ids, k)
        reach = float(np.sqrt(bound.max()) * (1 + 1e-9))
        return pa.RecordBatch.from_pydict({
            "cls": [cls], "block": [number], "lo": [data.min(axis=0).tolist()], "hi": [data.max(axis=0).tolist()],
            "reach": [reach], "bound": [bound.tobytes()], "ids": [ids.tobytes()], "data": [data.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        cls, held = None, []
        for batch in batches:
            for c, key, x in zip(*(col.to_pylist() for col in batch.columns)):
                if held and (c != cls or len(held) == rows):
                    yield block(cls, number, held)
                    number, held = number + 1, []
                cls = c
                held.append((key, x))
        if held:
            yield block(cls, number, held)
    return run


def _rows(batches: Iterator[pa.RecordBatch], *blobs: str) -> Iterator[dict]:
    """The rows one by one; the ``blobs`` stay in the batch's own memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_buffer() if c in blobs else batch.column(c)[i].as_py() for c in batch.schema.names}


def _targets(blocks):
    """The rows of a block once for every block of their class that they may
    find neighbours in.  ``blocks``: per class the numbers, lower and upper ends
    and shares; the blocks asking one block are dealt to its shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            number, lo, hi, *shares = blocks.value[r["cls"]]
            lo, hi = (np.reshape(x, (len(number), -1)) for x in (lo, hi))
            low, high = np.atleast_1d(r["lo"]), np.atleast_1d(r["hi"])
            own = int(np.argmax(number == r["block"]))
            bound, ids = np.frombuffer(r["bound"], np.float64), np.frombuffer(r["ids"], np.int64)
            data = np.frombuffer(r["data"], np.float64).reshape(len(ids), len(low))
            out = []
            for j in np.flatnonzero(_apart(lo, hi, low, high) <= r["reach"] ** 2 * (1 + 1e-9)):
                near = slice(None)
                if j != own and len(ids):
                    near = np.flatnonzero(_apart(data, data, lo[j], hi[j]) <= bound * (1 + 1e-9))
                    if not len(near):
                        continue
                out.append((r["cls"], int(number[j]), own % int(shares[0][j]) if shares else 0, bound[near].tobytes(), ids[near].tobytes(), data[near].tobytes()))
            for at in range(0, len(out), SENT_ROWS):
                cols = zip(*out[at:at + SENT_ROWS])
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["cls", "block", "share", "bound", "q_ids", "q_data"])
    return run


def _shared(blocks):
    """A block once for each of its shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = []
            for c, n in zip(batch.column("cls").to_pylist(), batch.column("block").to_pylist()):
                number, _, _, shares = blocks.value[c]
                times.append(int(shares[np.argmax(number == n)]))
            for i, n in enumerate(times):
                one = batch.slice(i, 1)
                for share in range(n):
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([share], pa.int32())], names=["cls", "block", "ids", "data", "share"])
    return run


def _shares(lo: np.ndarray, hi: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Per block a share for every ``SENT_ROWS`` blocks whose rows may reach it."""
    asking = np.zeros(len(reach), np.int64)
    for i in range(len(reach)):
        asking += _apart(lo, hi, lo[i], hi[i]) <= reach[i] ** 2 * (1 + 1e-9)
    return np.maximum(-(-asking // SENT_ROWS), 1)


def _meet(features: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches, "bound", "q_ids", "ids", "q_data", "data"):
            qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q, c = (np.frombuffer(r[x], np.float64).reshape(-1, features) for x in ("q_data", "data"))
            # the bound: what the row's own block rules out
            i, other, d = nearest_within(q, qi, np.frombuffer(r["bound"], np.float64), c, ci, k)
            yield pa.RecordBatch.from_pydict({"cls": pa.array([r["cls"]] * len(i), pa.string()), "key": pa.array(qi[i]),
                                              "neighbour": pa.array(other), "distance2": pa.array(d)})
    return run


def smote_knn(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBOURS,
              classes: Sequence | None = None, block_rows: int | None = None) -> DataFrame:
    """Each row's ``k`` nearest rows of its class by Euclidean distance of
    ``features``: cls (the label as text), key, rank (from 1), neighbour,
    distance2.  ``classes``: only these.  Keys are integers, one row each.

    Rows without label or key, or with a null or non-finite feature, have no
    neighbours and are none; ties go to the smaller key; a class of n rows
    gives min(k, n - 1) each; an empty table gives an empty result.
    """
    features = list(features)
    block_rows = block_rows or BLOCK_ROWS
    rows = usable(df, label, key, features)
    if classes is not None:
        rows = rows.filter(F.col("cls").isin([str(c) for c in classes]))
    rows = cut_lineage(rows)
    at = F.col("x").getItem
    spread = rows.agg(*[f(at(i)).alias(f"{n}{i}") for i in range(len(features)) for n, f in (("s", F.stddev_pop), ("m", F.avg))]).first()
    sd = {i: spread[f"s{i}"] for i in range(len(features)) if spread[f"s{i}"] and np.isfinite(spread[f"s{i}"])}
    axes = sorted(sd, key=lambda i: (-sd[i], i))[:CURVE_AXES]
    spark = df.sparkSession
    if axes:
        rows = rows.mapInArrow(_placed(axes, [spread[f"m{i}"] for i in axes], sd[axes[0]]), "cls string, key long, x array<double>, place long")
    else:
        rows = rows.withColumn("place", F.lit(0).cast("long"))
    order = ["cls", "place", "key"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("cls", "key", "x").mapInArrow(_pack(block_rows, k), _BLOCK))
    ends = blocks.select("cls", "block", "lo", "hi", "reach").toPandas()        # a row per BLOCK_ROWS rows of the data
    known = {}
    for c, g in ends.sort_values("block").groupby("cls"):
        lo, hi = (np.stack(g[x].to_numpy()) for x in ("lo", "hi"))
        known[c] = (g["block"].to_numpy(), lo, hi, _shares(lo, hi, g["reach"].to_numpy()))
    table = spark.sparkContext.broadcast(known)
    # a task's rows reach Python together, so a task gets few: about SENT_ROWS
    # blocks ask a share of a block, and there is a task for some shares
    tasks = max(1, -(-sum(int(g[3].sum()) for g in known.values()) // SHARES_A_TASK))
    place = ["cls", "block", "share"]
    asked = blocks.mapInArrow(_targets(table), "cls string, block long, share int, bound binary, q_ids binary, q_data binary")
    held = blocks.select("cls", "block", "ids", "data").mapInArrow(_shared(table), "cls string, block long, ids binary, data binary, share int")
    part = (asked.repartition(tasks, *place).join(held.repartition(tasks, *place).hint("shuffle_hash"), place)
            .mapInArrow(_meet(len(features), k), _TILE))
    best = Window.partitionBy("cls", "key").orderBy("distance2", "neighbour")
    return (part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("cls", "key", "rank", "neighbour", "distance2"))


def smote_oversample(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Rows of ``df`` (key, label, features as doubles) and synthetic rows
    that bring every class up to the largest.  A synthetic row lies at the share
    u of the way from a base row to one of its k nearest rows of the class;
    base, neighbour and u are seeded draws.  Further columns: draw (null for the
    rows of ``df``), base and neighbour (keys), u.  Synthetic rows have no key.

    A class whose only usable row has no neighbour repeats that row; a class
    without usable rows (see ``smote_knn``) stays as it is; rows without label
    are kept and are no class.
    """
    features = list(features)
    counts = {c: n for c, n in class_counts(df, label).items() if c is not None}
    most = max(counts.values(), default=0)
    plain = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    kind, kind_label = dict(df.dtypes)[key], dict(df.dtypes)[label]
    none = lambda t: F.lit(None).cast(t)
    out = plain.withColumns({"draw": none("long"), "base": none(kind), "neighbour": none(kind), "u": none("double")})
    small = sorted((c for c in counts if counts[c] < most), key=str)
    if not small:
        return out
    knn = cut_lineage(smote_knn(df, label, key, features, k, small))
    fit = usable(df, label, key, features)
    draw_hash = lambda what: hash_int(seeded_hash(F.concat(F.lit(f"{what}|"), F.col("draw").cast("string")), seed))
    for c in small:
        own = cut_lineage(fit.filter(F.col("cls") == str(c)))
        n = own.count()
        if not n:
            continue
        ranked = rank_within(own, "cls", "key", seed, "__rk", hash_digits({c: n})).select("__rk", F.col("key").alias("base"), "x")
        size = min(k, n - 1)
        draws = df.sparkSession.range(most - counts[c]).select(F.col("id").alias("draw"))
        draws = draws.select("draw", (draw_hash("base") % n + 1).alias("__rk"),
                             (draw_hash("near") % size + 1 if size else F.lit(0).cast("long")).alias("rank"),
                             (draw_hash("u").cast("double") / F.lit(_HASH_RANGE)).alias("u"))
        picked = draws.join(ranked, "__rk")
        if size:
            near = (knn.filter(F.col("cls") == str(c)).select(F.col("key").alias("base"), F.col("rank").cast("long").alias("rank"), "neighbour")
                    .join(own.select(F.col("key").alias("neighbour"), F.col("x").alias("y")), "neighbour"))
            picked = picked.join(near, ["base", "rank"])
        else:
            picked = picked.withColumns({"neighbour": F.col("base"), "y": F.col("x")})
        value = [(F.col("x")[i] + F.col("u") * (F.col("y")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)]
        out = out.unionByName(picked.select(none(kind).alias(key), F.lit(c).cast(kind_label).alias(label), *value, "draw",
                                            F.col("base").cast(kind).alias("base"), F.col("neighbour").cast(kind).alias("neighbour"), "u"))
    return out
