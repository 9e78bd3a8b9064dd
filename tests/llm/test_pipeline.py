"""The stages of corpus_pipeline.py against plain versions of their rules."""
import corpus_pipeline as C
from pyspark.sql import functions as F

from cohort_engine.llm import queries
from cohort_engine.llm.store import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "t-stage")
        assert out.dtypes == docs.dtypes
        kept.append((docs, out))
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = {r["doc_id"] for r in kept[0][1].collect()}
    known = [i for i in labels if labels[i] == 1]
    assert sum(i in good for i in known) >= 0.97 * len(known)
    assert sum(i in good for i in labels if labels[i] == 0) <= 0.1 * sum(1 for i in labels if labels[i] == 0)
    before = {r["doc_id"]: frozenset(tuple(w[k:k + 5]) for w in [r["text"].lower().split()] for k in range(max(len(w) - 4, 1))) for r in kept[1][0].collect()}
    after = {r["doc_id"] for r in kept[1][1].collect()}
    near = lambda a, b: 4 * len(a & b) >= 3 * len(a | b)
    assert not any(near(before[a], before[b]) for a in after for b in after if a < b)
    assert all(any(near(before[i], before[j]) for j in before if j != i) for i in before if i not in after)
    bad = {r["doc_id"] for r in queries.op2_decontaminate(spark, SF).collect()}
    assert {r["doc_id"] for r in kept[2][1].collect()} == after - bad
    last = C.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.agg(F.count_distinct("start")).first()[0] == docs.count()


def test_defined_cases(spark, tmpdir_path):
    """Rows without doc_id or text, repeated ids and rows, extra columns."""
    docs = table(spark, SF, "documents")
    extra = docs.orderBy("doc_id").limit(40).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    other = docs.filter("doc_id % 50 = 3").withColumn("doc_id", F.lit(1).cast(docs.schema["doc_id"].dataType))
    blank = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    every = docs.unionByName(extra).unionByName(other).unionByName(blank).unionByName(docs.limit(5))
    every = every.select("*", F.lit(1).alias("row"), F.lit("x").alias("node"), F.lit(2.5).alias("score"), F.lit(3).alias("n"))
    every.write.parquet(f"{tmpdir_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmpdir_path}/{name}.parquet")
    every = at = table(spark, tmpdir_path, "documents")
    for name, stage in C.STAGES[:-1]:
        at = written(stage(spark, at, tmpdir_path), "t-cases")
        assert at.dtypes == every.dtypes
        if name == "ngram_jaccard_join":
            assert at.filter("text IS NOT NULL").groupBy("text").count().filter("count > 1").isEmpty()
    last = C.STAGES[-1][1](spark, at, tmpdir_path)
    assert 0 < last.count() == at.count()


def test_no_documents(spark, tmpdir_path):
    docs = table(spark, SF, "documents").limit(0)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmpdir_path}/{name}.parquet")
    table(spark, SF, "documents").write.parquet(f"{tmpdir_path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, tmpdir_path), "t-none")
        assert out.dtypes == docs.dtypes and out.isEmpty()
    assert C.STAGES[-1][1](spark, docs, tmpdir_path).count() == 0


def test_registered():
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_store"]
    assert queries.queries()["pipeline"] is queries.pipeline and C.ORACLE_SQL is None
