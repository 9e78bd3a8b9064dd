"""Binomial GLM with logit link by Newton steps (ST6).

A step needs the weighted cross products of the columns and the score: one
aggregate of fixed size over the rows.  The d x d system is solved on the
driver (d: the number of terms, a parameter).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

STEPS = 50
SETTLED = 1e-11                 # largest relative change of the last step


@dataclass(frozen=True)
class Fit:
    terms: tuple
    beta: np.ndarray
    inverse: np.ndarray         # of the information matrix
    deviance: float
    null_deviance: float
    rows: int


def complete(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """y, x1 ... xd as doubles, rows with a null left out; x0 is the intercept."""
    cols = [F.col(label).cast("double").alias("y"), F.lit(1.0).alias("x0")]
    return df.select(*cols, *[F.col(f).cast("double").alias(f"x{i + 1}") for i, f in enumerate(features)]).dropna()


def _linear(beta: np.ndarray) -> Column:
    z = F.lit(0.0)
    for i, b in enumerate(beta):
        z = z + F.lit(float(b)) * F.col(f"x{i}")
    return z


def _step(data: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(information, score, deviance, rows) at ``beta``."""
    d = len(beta)
    z = F.col("z")
    # log(1 + exp(z)) without overflow
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    at = data.withColumn("z", _linear(beta)).withColumns({"p": p, "l": soft - F.col("y") * z}).withColumn("w", F.col("p") * (F.lit(1.0) - F.col("p")))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = at.agg(*[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs],
                 *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(d)], F.sum("l"), F.count(F.lit(1))).first()
    info = np.zeros((d, d))
    for (i, j), v in zip(pairs, row):
        info[i, j] = info[j, i] = v or 0.0
    return info, np.array([v or 0.0 for v in row[len(pairs):-2]]), 2 * (row[-2] or 0.0), row[-1]


def _inverse(info: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, with the terms brought to one scale first."""
    d = np.sqrt(np.diag(info))
    d[d == 0] = 1.0
    return np.linalg.pinv(info / np.outer(d, d), rcond=1e-13, hermitian=True) / np.outer(d, d)


def fit(df: DataFrame, label: str, features: Sequence[str]) -> Fit:
    """The maximum-likelihood fit.  Terms that others explain wholly share their
    effect (least-norm steps of the scaled terms).  A step that raises the deviance is halved; where
    the classes are separated the steps end after ``STEPS``."""
    data = complete(df, label, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        d = len(features) + 1
        beta = np.zeros(d)
        info, score, deviance, rows = _step(data, beta)
        if not rows:
            raise ValueError("no complete rows to fit")
        for _ in range(STEPS):
            move = _inverse(info) @ score
            for _ in range(20):
                new = _step(data, beta + move)
                if new[2] <= deviance * (1 + 1e-12):
                    break
                move = move / 2
            beta, (info, score, deviance, _) = beta + move, new
            if np.abs(move).max() <= SETTLED * max(1.0, np.abs(beta).max()):
                break
        share = data.agg(F.avg("y")).first()[0]
        null = 0.0 if share in (0.0, 1.0) else -2 * rows * (share * math.log(share) + (1 - share) * math.log(1 - share))
        return Fit(("(Intercept)", *features), beta, _inverse(info), deviance, null, rows)
    finally:
        data.unpersist()


def fitted_totals(df: DataFrame, label: str, features: Sequence[str], found: Fit) -> DataFrame:
    """Score equations: per term the total of x over the rows, weighted by the
    fitted probability.  At the optimum it is the total over the positive rows."""
    data = complete(df, label, features).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-_linear(found.beta))))
    row = data.agg(*[F.sum(F.col("p") * F.col(f"x{i}")).alias(f"t{i}") for i in range(len(found.terms))], F.count(F.lit(1)).alias("n"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col("n").alias("n"), F.col(f"t{i}").alias("total"))
                                          for i, t in enumerate(found.terms)])).alias("s")).select("s.*")
