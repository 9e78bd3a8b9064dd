"""Sources and sinks: optional/required sources, sinks, typed loads, model store."""
import os

import pytest
from pyspark.sql import functions as F

from cohort_engine.operators import models
from cohort_engine.sources import tables, typed


def test_read_optional_missing_is_empty(spark, tmpdir_path):
    df = tables.read_optional(spark, os.path.join(tmpdir_path, "nope"), "a int, b string")
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_require_sources_lists_all(spark, tmpdir_path):
    present = os.path.join(tmpdir_path, "present")
    spark.range(3).write.parquet(present)
    with pytest.raises(FileNotFoundError) as e:
        tables.require_sources(spark, {"a": present, "b": tmpdir_path + "/m1", "c": tmpdir_path + "/m2"})
    assert "m1" in str(e.value) and "m2" in str(e.value) and "present" not in str(e.value)


def test_csv_sink_and_typed_load(spark, tmpdir_path):
    src = spark.createDataFrame([("Random Forest", 0.6975, 1, " x "), ("Decision Tree", 0.68, 2, "")],
                                "Model string, `ROC-AUC` double, `N Rows` int, `Note` string")
    out = os.path.join(tmpdir_path, "metrics_csv")
    tables.write_table(src, out, fmt="csv")
    t = typed.typed_load(spark, out, normalize=True)
    assert t.columns == ["model", "roc_auc", "n_rows", "note"]
    assert dict(t.dtypes) == {"model": "string", "roc_auc": "double", "n_rows": "bigint", "note": "string"}
    notes = sorted((r["note"] is None, r["note"]) for r in t.collect())
    assert notes == [(False, "x"), (True, None)]


def test_read_table_none_is_a_value(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.csv")
    with open(p, "w") as fh:
        fh.write("id,cond\n1,None\n2,\n3,Asthma\n")
    df = tables.read_table(spark, p, "id int, cond string")
    assert sorted([r["cond"] is None for r in df.collect()]) == [False, False, True]
    df2 = tables.read_table(spark, p, "id int, cond string", null_values=("None",))
    assert df2.filter(F.col("cond").isNull()).count() == 2


def test_model_save_load_skip_bad(spark, tmpdir_path):
    train = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)], "a double, b double, label int")
    m = models.fit_model(train, ["a", "b"], "Logistic Regression")
    models.save_models({"Logistic Regression": m}, tmpdir_path)
    loaded = models.load_models(tmpdir_path, ["Logistic Regression", "Random Forest"])
    assert list(loaded) == ["Logistic Regression"]
    s1 = models.score(m, train.withColumn("k", F.monotonically_increasing_id()), "k").orderBy("k").collect()
    s2 = models.score(loaded["Logistic Regression"], train.withColumn("k", F.monotonically_increasing_id()),
                      "k").orderBy("k").collect()
    assert [r["p"] for r in s1] == pytest.approx([r["p"] for r in s2])


def test_publish_split_and_pretty(spark, tmpdir_path):
    from cohort_engine.operators import reports
    from cohort_engine.plans import modeling
    from places import SF001
    out = os.path.join(tmpdir_path, "test_split")
    modeling.publish_split(spark, SF001, out)
    t = spark.read.parquet(out)
    s = modeling.split_table(spark, SF001)
    assert t.count() == s.filter("split = 'test'").count()
    assert "patient_id" in t.columns and "label" in t.columns and "split" not in t.columns
    r = reports.pretty(t.select("patient_id", "label"), {"label": "Adherent", "nope": "x"})
    assert r.columns == ["patient_id", "Adherent"]


def test_typed_load_quotes_line_ends_and_bad_rows(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "r.csv")
    with open(p, "w", newline="") as fh:
        fh.write('Id, Free Text ,Score\r\n1," a ""b"",\nc ",0.5\r\n2,  ,1\r\n3\r\n4,x,2,left over\r\n,"",\r\n')
    t = typed.typed_load(spark, p, normalize=True, corrupt="bad")
    assert t.dtypes == [("id", "bigint"), ("free_text", "string"), ("score", "double"), ("bad", "string")]
    rows = [tuple(r) for r in t.collect()]
    assert (1, 'a "b",\nc', 0.5, None) in rows and (2, None, 1.0, None) in rows
    assert [r[3] is not None for r in sorted(rows, key=lambda r: r[0] or 0)] == [False, False, False, True, True]
    assert (4, "x", 2.0) in [r[:3] for r in rows] and (3, None, None) in [r[:3] for r in rows]
    q = os.path.join(tmpdir_path, "e.csv")
    with open(q, "w") as fh:
        fh.write("a,b\n")
    e = typed.typed_load(spark, q)
    assert e.count() == 0 and e.columns == ["a", "b"]


def test_csv_cells_come_back(spark, tmpdir_path):
    rows = [(1, ' "q" ', "l\nm"), (2, 'a\\"b', "\r\n"), (3, None, "\\"), (4, "", ",")]
    out = os.path.join(tmpdir_path, "cells")
    tables.write_table(spark.createDataFrame(rows, "k int, s string, t string"), out, fmt="csv")
    back = tables.read_table(spark, out, "k int, s string, t string", multiline=True)
    got = {r["k"]: (r["s"] or None, r["t"]) for r in back.collect()}
    assert got == {k: (s or None, t) for k, s, t in rows}
