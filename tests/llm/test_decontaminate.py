import re

from cohort_engine.llm import decontaminate as D


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def brute(docs, items, threshold):
    def grams(w, k):
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, it in items:
        w = words(it)
        if not w:
            continue
        own = grams(w, min(5, len(w)))
        for d, t in docs:
            if len(own & grams(words(t), min(5, len(w)))) >= threshold * len(own):
                out.add((d, i))
    return out


def test_containment_matches_brute_force(spark, documents):
    import random
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(1, 40))) for i in range(30)]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 400)).split()
        it = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):                   # some words changed
            it[rng.randrange(len(it))] = "changed"
        at = rng.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + [x.upper() + "," for x in it] + w[at:])))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contained(spark, documents(docs), table).collect()}
    want = brute(docs, items, 0.75)
    assert got == want and len(want) > 20


def test_sketch_leaves_out_no_item():
    for n in range(1, 300):
        need = -(-3 * n // 4)
        assert D.sketch_size(n, 0.75) >= n - need + 1


def test_edges(spark, documents):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "alpha beta"), (4, "one two three four five nine")],
                                  "item_id long, text string")
    docs = documents([(1, "x " + item), (1, "x " + item), (2, None), (3, ""), (None, "ALPHA-beta"), (5, "one two three"), (6, "clean " * 3000)])
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["n_shingles"], r["n_found"]) for r in D.contained(spark, docs, items).collect())
    assert got == [(0, 0, 1, 1), (1, 1, 3, 3)]
    kept = D.clean_documents(spark, docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6] and kept.columns == docs.columns
    unnamed = documents([(None, "one two three"), (None, "ALPHA-beta"), (1, "x " + item), (1, "clean")])
    assert sorted(r["text"] for r in D.clean_documents(spark, unnamed, items).collect()) == ["clean", "one two three"]
    assert D.contained(spark, documents([]), items).count() == 0
    assert D.contained(spark, docs, items.limit(0)).count() == 0
