import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohort_engine.llm import quality as Q
from cohort_engine.llm import queries

SF = "/root/testdata/sf0.01"


def test_one_row_of_each_labelled_document(spark, documents):
    """An id on many rows sends one of them to the fit, whichever way they come."""
    docs = documents([(1, f"text {i}") for i in range(500)] + [(2, None), (2, "b"), (3, "c"), (None, "d")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    got = Q.labelled(docs, labels).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(1, 1), (2, 0)]
    assert sorted(map(tuple, Q.labelled(docs.repartition(7), labels).collect())) == sorted(map(tuple, got))


def test_held_out_accuracy(spark):
    got = queries.op8_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    assert len(held) > 80
    assert np.mean([r["quality"] == r["predicted"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0 and got.count() == 1000


def test_scores_match_the_plain_model():
    rng = np.random.default_rng(0)
    texts = ["", None, "a", "aa aa aa", "Ünï cödé  text\n" * 30, " ".join(f"w{i}" for i in rng.integers(0, 50, 400))]
    model = Q.Model(rng.normal(size=(1 << Q.BITS, Q.DIM)).astype(np.float32), rng.normal(size=(Q.DIM, 2)).astype(np.float32),
                    np.array([0.1, -0.3], np.float32))
    got = Q.score_rows(pa.array(texts), *model.folded())
    for t, p, (ids, part) in zip(texts, got, Q.row_features(pa.array(texts))):
        logit = (part.astype(float) @ model.vectors[ids].astype(float) if len(ids) else np.zeros(Q.DIM)) @ model.output + model.bias
        assert abs(p - np.exp(logit[1]) / np.exp(logit).sum()) < 1e-4
    assert Q.score_rows(pa.array(texts[::-1]), *model.folded()).tolist() == got[::-1].tolist()


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (2, ""), (None, "text"), (3, "good words here")])
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1), (9, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels)                        # one labelled text, one class
    got = Q.score(spark, docs, model)
    assert sorted(got.columns) == sorted(docs.columns) and got.filter("score > 0.5").count() == 5     # the column score is replaced
    none = Q.train(documents([]), labels.limit(0))
    assert {r["score"] for r in Q.score(spark, docs.drop("score"), none).collect()} == {0.5}
    assert Q.score(spark, documents([]), none).count() == 0
    assert Q.labelled(docs, labels, 1).count() <= 1 and Q.labelled(docs, labels).filter(F.col("label") == 1).count() == 1
