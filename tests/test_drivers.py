"""Forest explanations cover the whole cohort, not only the held-out rows."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohort_engine.operators import explain
from cohort_engine.plans import catalog, modeling

from places import SF001


def scored_rows(model, df, feats, med):
    """Brute force: a row of its own for the record and for every feature at its median."""
    parts = [df.withColumn("ablated", F.lit(None).cast("string"))]
    parts += [df.withColumn(c, F.lit(med[c])).withColumn("ablated", F.lit(c)) for c in feats]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    p = vector_to_array(F.col("probability"))[1]
    return {(r[0], r[1]): r[2] for r in model.transform(rows).select(modeling.KEY, "ablated", p).collect()}


def test_every_record_is_explained_against_all_medians(spark):
    every = modeling.split_table(spark, SF001)
    feats = modeling.feature_names(every)
    model = modeling.fitted(spark, SF001, "Random Forest")
    med = explain.baseline_medians(every, feats)
    got = catalog.q_local_drivers(spark, SF001)
    p = scored_rows(model, every.select(modeling.KEY, *[F.col(c).cast("double").alias(c) for c in feats]), feats, med)
    want = {}
    for (k, c), v in p.items():
        if c is not None and abs(p[k, None] - v) >= 1e-4:
            want.setdefault(k, []).append((-round(abs(p[k, None] - v), 12), c, p[k, None] - v))
    rows = {}
    for r in got.orderBy(modeling.KEY, "rank").collect():
        assert r["rank"] == len(rows.setdefault(r[0], [])) + 1 and r["base_p"] == pytest.approx(p[r[0], None], abs=1e-12)
        assert r["median"] == med[r["feature"]]
        rows[r[0]].append((r["feature"], r["delta"]))
    # a record has rows unless no feature moves its score by 1e-4
    assert rows.keys() == want.keys()
    for k, found in rows.items():
        best = sorted(want[k])[:6]
        assert [f for f, _ in found] == [c for _, c, _ in best]
        assert [d for _, d in found] == pytest.approx([d for _, _, d in best], abs=1e-12)
    assert rows.keys() & {r[0] for r in every.filter("split = 'train'").select(modeling.KEY).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    # dealt once before scoring; nothing is exchanged or ranked by key after it
    assert plan.count("Exchange") <= 1 and "Window" not in plan
