import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohort_engine.llm import lm_score
from cohort_engine.llm import queries as Q

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\0"]


def base(texts, train):
    count = Counter(w for t in train for w in tokens(t))
    whole = sum(count.values()) + len(count) + 1
    return [(len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(math.log10((count[w] + 1) / whole) for w in tokens(t))) for t in texts]


@pytest.mark.parametrize("head", [lm_score.HEAD_WORDS, 16])
def test_base_score_is_exact_and_model_beats_it(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD_WORDS", head)    # the joined part must give the same
    got = {r["doc_id"]: r for r in Q.op1_lm_score(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    ids = sorted(docs)
    for i, (n, known, score) in zip(ids, base([docs[i] for i in ids], [docs[i] for i in ids if not held[i]])):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held[i], n, known)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] <= 0
    for side in (True, False):
        assert sum(got[i]["score"] for i in ids if held[i] == side) > sum(got[i]["base_score"] for i in ids if held[i] == side)


def test_edge_rows(spark, documents):
    docs = documents([(1, "a b a"), (2, None), (3, ""), (1, "a b a"), (None, "a \t c")])
    model = lm_score.train(spark, docs)
    assert (model.tokens, model.types) == (13, 4)
    rows = lm_score.score(spark, docs, model, ["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in rows) == [(0, 3, 3), (1, 4, 4), (1, 4, 4), (2, 1, 1), (3, 1, 1)]
    none = documents([])
    assert lm_score.score(spark, none, model, ["doc_id"]).count() == 0
    empty = lm_score.train(spark, none)
    assert [r["base_score"] for r in lm_score.score(spark, docs.limit(1), empty, ["doc_id"]).collect()] == [0.0]


def test_filter_reads_back_levels():
    rng = np.random.default_rng(1)
    keys = lm_score.textkit.mix64(np.arange(4000, dtype=np.uint64))
    level = rng.integers(1, 9, 4000)
    bits = np.zeros(1 << lm_score.SEGMENT_BITS, bool)
    for q in range(1, 9):
        for spots in lm_score.places(keys[level >= q], q, 1, 4)[1]:
            bits[spots()] = True
    f = lm_score.Filter(np.packbits(bits, bitorder="little"), 4)
    got = f.levels(keys, 20)
    assert (got >= level).all() and (got == level).mean() > 0.99      # errors are one-sided and rare
    assert (f.levels(lm_score.textkit.mix64(keys), 20) == 0).mean() > 0.99


def test_a_full_filter_starts_at_a_higher_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm_score.train(spark, docs.select("text"), most_segments=1, least_bits=300)
    assert model.start > 1 and len(model.filter.data) == 1 << (lm_score.SEGMENT_BITS - 3)
    scored = lm_score.score(spark, docs, model, ["doc_id"])
    assert scored.filter(F.col("score") <= 0).count() == docs.count()


def test_a_head_filter_does_not_coarsen_the_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda model: {r["doc_id"]: r for r in lm_score.score(spark, docs, model, ["doc_id"]).collect()}
    whole, head = (lm_score.train(spark, docs.select("text"), **k) for k in ({}, {"most_segments": 1, "least_bits": 300}))
    assert whole.start == 1 and head.start > 1
    one, two = rows(whole), rows(head)
    assert set(one) == set(two)
    for i, r in one.items():
        assert two[i]["score"] == pytest.approx(r["score"], rel=2e-3)
        assert (two[i]["n_known"], two[i]["base_score"]) == (r["n_known"], pytest.approx(r["base_score"]))


def test_a_shard_answers_like_the_whole_filter():
    rng = np.random.default_rng(2)
    segments, size = 19, 1 << (lm_score.SEGMENT_BITS - 3)
    data = np.packbits(rng.random(segments << lm_score.SEGMENT_BITS) < 0.6, bitorder="little")
    grams = lm_score.Grams(np.unique(np.append(lm_score.textkit.mix64(np.arange(999, dtype=np.uint64)), lm_score.END)), np.arange(1000), 6)
    keys, asked, shard = grams.shards(np.arange(0, 3000, 3), segments)
    assert len(np.unique(shard)) == 3 and (np.concatenate(grams.parts)[asked] == keys).all()
    want = lm_score.Filter(data, 4).levels(keys, 255)
    for s in range(3):
        part = data[s * lm_score.SHARD * size:(s + 1) * lm_score.SHARD * size]
        f = lm_score.Filter(part, 4, segments, s * lm_score.SHARD)
        assert (f.levels(keys[shard == s], 255) == want[shard == s]).all()


def test_slices_and_counts_travel_in_fewer_bytes_than_their_keys(spark):
    rng = np.random.default_rng(6)
    text = " ".join(f"w{i}" for i in rng.zipf(1.3, 60_000) % 30_000)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    row = next(lm_score._count(6)(iter([batch]))).to_pydict()
    counts, plain = lm_score.Counts(0), 0
    for f, w, p in zip(row["fragment"], row["words"], row["pairs"]):
        plain += 8 * (len(lm_score.unpacked(w)) + len(lm_score.unpacked(p)))
    assert sum(map(len, row["words"] + row["pairs"])) < 0.85 * plain
    for i in range(len(row["fragment"])):
        counts.add({k: v[i] for k, v in row.items()})
    counts.settle()
    assert counts.words[1][0].sum() == 60_001 == counts.pairs[1][0].sum()
