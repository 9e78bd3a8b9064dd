import math

import pytest
from pyspark.sql import functions as F

from cohort_engine.llm import mixing as M
from cohort_engine.llm.store import written

SF = "/root/testdata/sf0.001"


def water(sizes):
    """Targets by the rule: share by weight, stop at three times, reshare."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole >= 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def prepared(spark, docs):
    sizes = written(M.sized(docs), "t-sizes")
    return sizes, written(M.source_targets(sizes), "t-sources")


def test_targets_follow_the_rule(spark, documents):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (500, "b"), (40, "c"), (0, "d"), (900, "e"), (7, None), (3, "é"), (60, "Z")])]
    _, sources = prepared(spark, documents(rows))
    got = {r["source"]: r["target"] for r in sources.collect()}
    want = water({s: n for n, s in [(5, "a"), (500, "b"), (40, "c"), (0, "d"), (900, "e"), (7, None), (3, "é"), (60, "Z")]})
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_pieces_are_exact_disjoint_and_balanced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, sources = prepared(spark, docs)
    again = M.mix(spark, sizes, sources, block_words=64, shard_words=4096)
    pieces = [r.asDict() for r in again.collect()]
    assert pieces == [r.asDict() for r in again.collect()] or sorted(map(str, pieces)) == sorted(str(r.asDict()) for r in again.collect())
    want = {r["source"]: r["target_words"] for r in sources.collect()}
    got, cover, shards = {}, {}, {}
    for p in pieces:
        got[p["source"]] = got.get(p["source"], 0) + p["n_words"]
        cover.setdefault((p["row"], p["epoch"]), []).append((p["from_word"], p["n_words"]))
        shards.setdefault(p["shard"], []).append(p["position"])
    assert got == {s: n for s, n in want.items() if n}
    size = {r["row"]: r["size"] for r in sizes.collect()}
    for (row, _), parts in cover.items():                # from the start on, without a gap or a word twice
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= size[row]
    assert max(e for _, e in cover) <= 2
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 8


def test_split_tree_keeps_quotas_and_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 5000), (1, 0), (2, 37), (3, 800)], "src long, blocks long")
    rows = M.split_tree(spark, quotas, 5).collect()
    total, load = {}, {}
    for r in rows:
        assert r["blocks"] >= 0
        total[r["src"]] = total.get(r["src"], 0) + r["blocks"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["blocks"]
    assert total == {0: 5000, 1: 0, 2: 37, 3: 800} and len(load) == 32 and max(load.values()) - min(load.values()) <= 1
    n, k, d = 60, 23, 31
    u = spark.range(4000).select(M.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"),
                                                  (F.col("id") + 0.5) / 4000).alias("x"))
    got = {r["x"]: r["count"] / 4000 for r in u.groupBy("x").count().collect()}
    for x in range(max(0, d - n + k), min(k, d) + 1):
        p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d)
        assert got.get(x, 0) == pytest.approx(p, abs=1 / 1000)


def test_mixed_documents(spark, documents):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, None, "x"), (None, "e f", None), (3, "g " * 40, "y"), (4, "", "z")]
    docs = documents(rows)
    out = M.mix_documents(spark, docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    sizes, sources = prepared(spark, docs)
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert words == {r["source"]: r["target_words"] for r in sources.collect() if r["target_words"]}
    assert M.mix_documents(spark, documents([])).count() == 0
