"""Stream scoring equals batch scoring (stateless M8 over readStream)."""
import os

from pyspark.sql import functions as F

from cohort_engine.operators import features as feat
from cohort_engine.operators import models
from cohort_engine.plans import pipeline
from cohort_engine.sources import bindings
from cohort_engine.streaming.scoring import score_profiles, score_records, start_scoring_stream

from places import SF001


def test_stream_matches_batch(spark, tmpdir_path):
    raw = bindings.cohort(spark, SF001)
    mi = pipeline.model_input(raw)
    feats = [c for c in mi.columns if c not in ("patient_id", "label")]
    model = models.fit_model(mi, feats, "Logistic Regression")
    src = os.path.join(tmpdir_path, "profiles")
    # two files arrive: the stream must pick up both
    raw.filter(F.col("patient_id") % 2 == 0).write.parquet(src + "/part_a")
    raw.filter(F.col("patient_id") % 2 == 1).write.mode("append").parquet(src + "/part_b")
    q = start_scoring_stream(spark, model, src + "/*", raw.schema, os.path.join(tmpdir_path, "sink"),
                             os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(tmpdir_path, "sink"))
    batch = score_profiles(raw, model)
    assert streamed.count() == raw.count()
    a = {r["patient_id"]: round(r["probability"], 9) for r in streamed.collect()}
    b = {r["patient_id"]: round(r["probability"], 9) for r in batch.collect()}
    assert a == b


def test_factor_rules_shape(spark):
    f = feat.derive_features(bindings.cohort(spark, SF001))
    out = feat.factor_rules(f)
    assert out.count() == 6 * f.count()


def test_stream_restart_processes_only_new_files(spark, tmpdir_path):
    """A restarted scoring query resumes from its checkpoint: files already
    committed are not scored twice, new files are."""
    raw = bindings.cohort(spark, SF001)
    mi = pipeline.model_input(raw)
    feats = [c for c in mi.columns if c not in ("patient_id", "label")]
    model = models.fit_model(mi, feats, "Logistic Regression")
    src, sink, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "ckpt"))
    first = raw.filter(F.col("patient_id") % 3 == 0)
    second = raw.filter(F.col("patient_id") % 3 != 0)
    first.write.parquet(src + "/batch1")
    start_scoring_stream(spark, model, src + "/*", raw.schema, sink, ckpt).awaitTermination(120)
    n1 = spark.read.parquet(sink).count()
    second.write.parquet(src + "/batch2")
    start_scoring_stream(spark, model, src + "/*", raw.schema, sink, ckpt).awaitTermination(120)
    out = spark.read.parquet(sink)
    assert n1 == first.count()
    assert out.count() == raw.count() == out.select("patient_id").distinct().count()


def test_records_get_the_batch_probabilities(spark, tmpdir_path):
    raw = bindings.cohort(spark, SF001)
    p = pipeline.fit_cleaning(raw)
    mi = pipeline.model_input(raw)
    feats = [c for c in mi.columns if c not in ("patient_id", "label")]
    model = models.fit_model(mi, feats, "Logistic Regression")
    want = {r["patient_id"]: r["p"] for r in models.score(model, mi, "patient_id").collect()}
    pipeline.save_cleaning(spark, p, tmpdir_path + "/cleaning")
    again = pipeline.load_cleaning(spark, tmpdir_path + "/cleaning")
    assert again == p
    got = {r["patient_id"]: r["probability"] for r in score_records(raw, model, again).collect()}
    assert got == want
    nulls = raw.filter("claim_amount IS NULL OR chronic_condition IS NULL OR annual_contribution IS NULL")
    assert not nulls.isEmpty()
    raw.write.parquet(tmpdir_path + "/src/a")
    start_scoring_stream(spark, model, tmpdir_path + "/src/*", raw.schema, tmpdir_path + "/sink", tmpdir_path + "/ckpt",
                         cleaning=again).awaitTermination(120)
    streamed = {r["patient_id"]: r["probability"] for r in spark.read.parquet(tmpdir_path + "/sink").collect()}
    assert streamed == want


def test_prepared_needs_no_key(spark):
    raw = bindings.cohort(spark, SF001)
    p = pipeline.fit_cleaning(raw)
    twice = raw.unionByName(raw).withColumn("patient_id", F.lit(None).cast("long"))
    out = pipeline.prepared(twice, p)
    assert out.count() == 2 * raw.count() and out.filter("refill_gap IS NULL").count() == 2 * raw.filter("expected_refills IS NULL OR refills_received IS NULL").count()
    assert "Join" not in pipeline.prepared(raw.select("*").limit(5), p)._jdf.queryExecution().analyzed().toString().split("GlobalLimit")[0]
    joined = feat.feature_matrix(raw, pipeline.apply_cleaning(raw, p), rules=p.rules)
    one = pipeline.prepared(raw, p)
    assert one.columns == joined.columns and sorted(map(str, one.collect())) == sorted(map(str, joined.collect()))
