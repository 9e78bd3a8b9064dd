"""Classification tree with exact thresholds (M2), grown level by level.

For a level, the rows of all open nodes are counted by (node, column, value)
with map-side combine; running sums over the value order give both sides of
every candidate split (``rankcum``: range partitions, no task holds a node or a
column).  One best split per open node comes back, at most 2 ** depth rows.  A
row's node is an expression of its columns, so no node ids are stored.

Candidates lie between neighbouring distinct values, in the middle.  The split
with the least Gini impurity counts, ties to the earlier column, then to the
smaller threshold.  A node is a leaf when it is pure, at ``max_depth``, smaller
than ``min_split`` or without a candidate that leaves ``min_leaf`` rows on both
sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_engine.operators.rankcum import cumulative
from cohort_engine.session import staged

ROOT = 1                        # the children of node k are 2k and 2k + 1


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float            # up to it: left


@dataclass
class Tree:
    features: tuple
    splits: dict = field(default_factory=dict)      # node -> Split
    counts: dict = field(default_factory=dict)      # node -> (rows, rows of class 1)

    def probability(self, node: int) -> float:
        n, pos = self.counts[node]
        return pos / n

    def case(self, leaf, node: int = ROOT) -> str:
        """SQL for ``leaf(node)`` of a row's leaf; a null or NaN goes right."""
        s = self.splits.get(node)
        if s is None:
            return leaf(node)
        name = "`" + self.features[s.feature].replace("`", "``") + "`"
        return (f"CASE WHEN CAST({name} AS DOUBLE) <= CAST('{s.threshold!r}' AS DOUBLE) THEN {self.case(leaf, 2 * node)} "
                f"ELSE {self.case(leaf, 2 * node + 1)} END")

    def importances(self) -> dict[str, float]:
        """Decrease of impurity by column, adding up to 1 (0 for all without a split)."""
        gain = dict.fromkeys(self.features, 0.0)
        for node, s in self.splits.items():
            gain[self.features[s.feature]] += _spread(*self.counts[node]) - sum(_spread(*self.counts[c]) for c in (2 * node, 2 * node + 1))
        total = sum(gain.values())
        return {f: g / total if total else 0.0 for f, g in gain.items()}


def _spread(n: int, pos: int) -> float:
    """Gini impurity of a node times its rows."""
    return n - (pos * pos + (n - pos) * (n - pos)) / n


def _purity(n, pos):
    n, pos = n.cast("double"), pos.cast("double")
    return (pos * pos + (n - pos) * (n - pos)) / n


def _values(data: DataFrame, node: Column, features: Sequence[str]) -> DataFrame:
    """(node, f, v, n, pos): rows of every distinct value of every column."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(features))]))
    return (data.select(node.alias("node"), "y", cells.alias("c")).groupBy("node", F.col("c.f").alias("f"), F.col("c.v").alias("v"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos")))


def candidates(data: DataFrame, node: Column, features: Sequence[str], min_leaf: int = 1) -> DataFrame:
    """(node, f, threshold, purity, n_left, pos_left, n, pos) of every split
    that leaves ``min_leaf`` rows on both sides, all given nodes at once."""
    counted = _values(data, node, features).withColumn("w", F.col("v"))
    run = cumulative(counted, ["node", "f"], "v", ["n", "pos", "w"], with_next=True)
    run = run.select("node", "f", "v", F.col("next_w").alias("after"), F.col("cum_n").cast("long").alias("n_left"),
                     F.col("cum_pos").cast("long").alias("pos_left"))
    # one row a node, so at most 2 ** depth of them
    whole = data.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    middle = F.col("v") / 2 + F.col("after") / 2
    # neighbouring doubles and infinities have no middle
    inside = (middle >= F.col("v")) & (middle < F.col("after")) & ~F.isnan(middle)
    left, right = _purity(F.col("n_left"), F.col("pos_left")), _purity(F.col("n") - F.col("n_left"), F.col("pos") - F.col("pos_left"))
    return (run.join(F.broadcast(whole), "node").filter((F.col("n_left") >= min_leaf) & (F.col("n") - F.col("n_left") >= min_leaf) & F.col("after").isNotNull())
            .select("node", "f", F.when(inside, middle).otherwise(F.col("v")).alias("threshold"), (left + right).alias("purity"),
                    "n_left", "pos_left", "n", "pos"))


def best_splits(found: DataFrame) -> DataFrame:
    """The candidate of each node that counts."""
    order = F.struct((-F.col("purity")).alias("p"), "f", "threshold", "n_left", "pos_left", "n", "pos")
    return found.groupBy("node").agg(F.min(order).alias("b")).select("node", "b.f", "b.threshold", (-F.col("b.p")).alias("purity"), "b.n_left", "b.pos_left", "b.n", "b.pos")


def prepared(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """y (0 or 1) and x0, x1, ... as doubles.  Rows with a null label or a null
    or NaN column take no part; -0.0 is 0.0."""
    x = {f"x{i}": F.col(f).cast("double") + F.lit(0.0) for i, f in enumerate(features)}
    return df.select(F.col(label).cast("int").alias("y"), *[v.alias(k) for k, v in x.items()]).dropna()


def fit(df: DataFrame, label: str, features: Sequence[str], max_depth: int = 6, min_split: int = 20, min_leaf: int = 10) -> Tree:
    """The tree of ``df``; its depth bounds the driver's part (2 ** depth nodes).
    Empty tables raise a ValueError."""
    data = staged(prepared(df, label, features), "tree")
    n, pos = data.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        raise ValueError("no complete rows to fit")
    inner = Tree(tuple(f"x{i}" for i in range(len(features))), counts={ROOT: (n, pos)})
    level = [ROOT]
    for _ in range(max_depth):
        open_ = [k for k in level if inner.counts[k][0] >= max(min_split, 2) and 0 < inner.counts[k][1] < inner.counts[k][0]]
        if not open_ or not features:
            break
        node = F.expr(inner.case(str))
        here = data.filter(node.isin(open_))
        level = []
        for r in best_splits(candidates(here, node, features, min_leaf)).collect():
            k = r["node"]
            inner.splits[k] = Split(r["f"], r["threshold"])
            inner.counts[2 * k] = (r["n_left"], r["pos_left"])
            inner.counts[2 * k + 1] = (r["n"] - r["n_left"], r["pos"] - r["pos_left"])
            level += [2 * k, 2 * k + 1]
    return Tree(tuple(features), inner.splits, inner.counts)


def pipeline_model(tree: Tree) -> PipelineModel:
    """The tree as expressions inside a PipelineModel that can be saved; adds
    ``features`` and ``probability`` like a library classifier."""
    p = tree.case(lambda k: f"CAST('{tree.probability(k)!r}' AS DOUBLE)")
    return PipelineModel([
        SQLTransformer(statement="SELECT * FROM __THIS__"),
        VectorAssembler(inputCols=list(tree.features), outputCol="features", handleInvalid="keep"),
        SQLTransformer(statement=f"SELECT *, 1.0D - __p1 AS __p0 FROM (SELECT *, {p} AS __p1 FROM __THIS__)"),
        VectorAssembler(inputCols=["__p0", "__p1"], outputCol="probability"),
    ])
