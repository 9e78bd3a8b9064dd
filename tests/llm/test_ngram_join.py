import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from cohort_engine.llm import ngram_join as J
from cohort_engine.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(12))
    rows = []
    for family in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randint(8, 150))]
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):               # chains of ever more changes
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = own
            rows.append(" ".join(own) + (" " + line if rng.random() < 0.5 else ""))
    rows += [line] * 3 + ["", "a b", "A B", "a b c"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1])
def test_matches_brute_force(spark, documents, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in J.link_components(spark, documents(rows)).collect())
    assert got == brute(rows)


def test_exact_step_finds_what_the_stars_miss(spark, documents, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(J, "star_pairs", lambda shared, *_: shared.selectExpr("node a", "n na", "node b", "n nb").limit(0))
    got = sorted(tuple(r) for r in J.link_components(spark, documents(rows)).collect())
    assert got == brute(rows)


def test_shared_groups_come_out_whole_in_any_cut():
    rng = np.random.default_rng(2)
    rows = np.zeros(900, J._POSTING)
    rows["h"], rows["node"] = rng.integers(0, 300, 900), np.arange(900)
    many = {int(h) for h, n in zip(*np.unique(rows["h"], return_counts=True)) if n > 1}
    want = sorted(int(r["node"]) for r in rows if int(r["h"]) in many)
    for cut in (1, 7, 900):
        state, out = J.Shared(), []
        for at in range(0, 900, cut):
            out += state.add(rows[at:at + cut])["node"].tolist()
        assert sorted(out) == want


def test_edges(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents([(5, text), (5, text), (9, text), (None, text), (7, None), (8, ""), (8, ""), (None, None), (2, "long " * 20000)])
    got = sorted((r["doc_id"] or -1, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"])
                 for r in J.link_components(spark, docs).collect())
    assert got == [(-1, 0, -1), (-1, 36, 5), (2, 1, 2), (5, 36, 5), (5, 36, 5), (7, 0, 7), (8, 0, 8), (8, 0, 8), (9, 36, 5)]
    kept = J.one_of_each(spark, docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 5, 7, 8] and kept.columns == docs.columns
    assert J.link_components(spark, documents([])).count() == 0


def test_each_text_of_a_shared_id_is_judged(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = documents([(1, a), (1, b), (1, b), (3, a + " more"), (None, c), (None, c + " more"), (None, b), (None, None), (None, None), (4, "")])
    kept = J.one_of_each(spark, docs)
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    assert (1, a) in got and (1, b) in got and sum(i == -1 and t.startswith("c0") for i, t in got) == 1
    assert sorted(i for i, _ in got) == [-1, -1, -1, 1, 1, 4] and kept.dtypes == docs.dtypes


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 60)} == {1}


def test_fingerprints_follow_the_set():
    part = lambda *t: pa.RecordBatch.from_arrays([pa.array(t)], names=["text"])
    x = J.fingerprints(*J.doc_sets(part("a b c d e f a b c d e f", "A b c d e  f a b c d e f", "a b c d e f", ""), 5))
    assert x[0] == x[1] != x[2] and x[3] == 0


def test_star_pairs_that_share_too_little_are_not_verified(spark):
    shared = [(1, 11, 100, 0), (1, 12, 100, 0)] + [(h, node, 100, h) for h in range(2, 22) for node in (13, 14)]
    nodes = spark.createDataFrame([(x, x, 100) for x in range(11, 15)], "node long, rep long, n long")
    df = spark.createDataFrame(shared, "h long, node long, n long, rank int")
    assert [tuple(r) for r in J.star_pairs(df, nodes, None, None, 0).collect()] == [(13, 100, 14, 100)]


def test_texts_that_link_share_enough_of_their_prefixes(spark):
    rng, rows = random.Random(8), []
    for _ in range(3000):
        n = rng.randint(1, 90)
        a = set(rng.sample(range(400), n))
        b = (a - set(rng.sample(sorted(a), min(n, rng.randint(0, 1 + n // 6))))) | set(rng.sample(range(400), rng.randint(0, 1 + n // 6)))
        if b:
            px, py = (set(sorted(x)[:int(J.prefix_size(np.array([len(x)]))[0])]) for x in (a, b))
            rows.append((len(px & py), len(a), len(b), 4 * len(a & b) >= 3 * len(a | b)))
    df = spark.createDataFrame(rows, "s long, na long, nb long, links boolean").withColumn("enough", J.enough(F.col("s"), "na", "nb"))
    got = {(r["links"], r["enough"]) for r in df.collect()}
    assert (True, False) not in got and {(True, True), (False, False)} <= got


@pytest.mark.parametrize("most,fragments", [(J.SET_FRAGMENT, 1), (20, 8)])
def test_sets_are_cut_by_their_size(spark, documents, monkeypatch, most, fragments):
    rows, used = corpus(3), []
    real = J.verified
    monkeypatch.setattr(J, "SET_FRAGMENT", most)
    monkeypatch.setattr(J, "verified", lambda *a: used.append(a[5]) or real(*a))
    got = sorted(tuple(r) for r in J.link_components(spark, documents(rows)).collect())
    assert got == brute(rows) and set(used) == {-(-max(n for _, n, _ in got) // most)} and fragments - 1 <= used[0] <= fragments


def _marked(sets):
    """A node of each set with its marks, and a posting of each n-gram."""
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    m = J.marks(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), ptr)
    rows = [(k, len(s), *map(int, x)) for k, (s, x) in enumerate(zip(sets, m))]
    return rows, "node long, n long, " + ", ".join(f"{c} long" for c in J.MARKS)


def test_marks_part_no_texts_that_link(spark):
    rng, sets = random.Random(9), []
    for _ in range(400):
        a = rng.sample(range(2000), rng.randint(1, 300))
        b = a[rng.randint(0, 1 + len(a) // 3):] + rng.sample(range(2000, 4000), rng.randint(0, 1 + len(a) // 3))
        sets += [set(a), set(b)]
    rows, schema = _marked(sets)
    df = spark.createDataFrame(rows, schema)
    x, y = (df.select(*[F.col(c).alias(p + c) for c in df.columns]).filter(f"{p}node % 2 = {k}") for k, p in enumerate("xy"))
    got = {r["xnode"]: r["near"] for r in x.join(y, F.col("ynode") == F.col("xnode") + 1).withColumn("near", J.near_enough("x", "y", "xn", "yn")).collect()}
    links = [4 * len(sets[k] & sets[k + 1]) >= 3 * len(sets[k] | sets[k + 1]) for k in range(0, len(sets), 2)]
    assert all(got[2 * k] for k, linked in enumerate(links) if linked) and sum(links) > 50
    assert sum(not x for x in got.values()) > 50


def test_open_pairs_of_a_common_line_are_not_all_pairs(spark):
    line = list(range(12))                        # that all texts share, and of which two texts link
    sets = [set(line + [1000 * k + i for i in range(40)]) for k in range(1, 30)]
    sets.append(sets[0] - {1000} | {77})
    rows, schema = _marked(sets)
    shared = [(h, k, len(s), r) for k, s in enumerate(sets) for r, h in enumerate(line)]
    pairs = J.open_pairs(spark.createDataFrame(shared, "h long, node long, n long, rank int"), spark.createDataFrame(rows, schema),
                         spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in pairs.collect()] == [(0, 29, 52, 52)]


def test_many_pairs_are_verified_in_parts_and_tables_go(spark, documents, monkeypatch):
    """The sets that pairs move at a time follow the text; postings, pairs and sets don't stay."""
    import os
    rows, calls = corpus(4), []
    real, verified = J.links, J.verified
    monkeypatch.setattr(J, "LEAST_GRAMS", 1)
    monkeypatch.setattr(J, "verified", lambda *a: calls.append(1) or verified(*a))
    monkeypatch.setattr(J, "links", lambda spark, docs, nodes, pairs, grams, *more: real(spark, docs, nodes, pairs, 1500, *more))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    got = sorted(tuple(r) for r in J.link_components(spark, documents(rows)).collect())
    assert got == brute(rows) and len(calls) > len(J.STAR_STEPS) + 1
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before}
    assert not left & {"ngram-postings", "ngram-star", "ngram-asked", "ngram-links", "ngram-open", "ngram-rest", "links"}
