import random
import re
from collections import Counter

import pytest

from cohort_engine.llm import collocations as C


def brute(rows, least, words=5, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    for lang in n:
        cand = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        dead = set()
        for q, b in cand.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if q[i:i + size] in cand and b >= cand[q[i:i + size]]:
                        dead.add(q[i:i + size])
        rows_ = []
        for p, a in cand.items():
            if p not in dead:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                rows_.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, "p", 2, 3) for i, (t, x) in enumerate(rows)],
                                 "doc_id long, text string, lang string, k int, phrase string, n int, h long")


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "Ab", "é", "É", "x-y", "new", "york", "city"]
    made = []
    for _ in range(docs):
        text = []
        for _ in range(rng.randrange(0, 60)):
            text.append(rng.choice(words) if rng.random() < 0.7 else rng.choice(["new york city", "new  york\tcity hall", "of the the the"]))
            text.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! "]))
        made.append(("".join(text), rng.choice(["en", "en", "fr", None])))
    return made


@pytest.mark.parametrize("sample,lowered", [(0.3, 0.4), (0.02, 1.0), (1.0, 1.0)])
def test_matches_plain_counts(spark, sample, lowered):
    """The sample decides the passes, never the rows."""
    rows = corpus(4) + [(None, "en"), ("", "en"), ("one", None), ("same words here. " * 30, "de"), ("same words here. " * 30, "de")]
    got = sorted(tuple(r) for r in C.collocations(spark, frame(spark, rows), least=12, sample=sample, lowered=lowered).collect())
    assert got == brute(rows, 12) and len(got) > 20


def test_a_poor_sample_needs_more_passes(spark, monkeypatch):
    """A phrase whose words the sample never saw is found by expansion."""
    passes = []
    real = C.counts
    monkeypatch.setattr(C, "counts", lambda docs, pick, least: passes.append(least) or real(docs, pick, least))
    rows = [("alpha beta gamma delta epsilon.", "en")] * 15
    df = frame(spark, rows).coalesce(1)
    monkeypatch.setattr(type(df.select("lang")), "sample", lambda self, *a, **k: self.limit(0))
    got = sorted(tuple(r) for r in C.collocations(spark, df, least=10).collect())
    assert got == brute(rows, 10) == [("en", 1, "alpha beta gamma delta epsilon", 15, 15, 15, 75, 5000)]
    assert len(passes) == 3 + 1 + 4          # sample, full, one more for every longer phrase


def test_long_text_best_and_ties(spark):
    rows = [("ba ab " * 40_000, "en"), ("q r. s t. " * 20, "en"), ("z" * 300_000 + " y", "fr")]
    got = sorted(tuple(r) for r in C.collocations(spark, frame(spark, rows), least=20, best=3).collect())
    assert got == brute(rows, 20, best=3)
    assert C.collocations(spark, frame(spark, rows).limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    a, n, x, y = 10**16 - 7, 10**17 - 3, 10**16 + 11, 10**16 + 13
    df = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(17,0))"
    got = df.selectExpr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) as s").first()["s"]
    assert got == 1000 * a * n // (x * y)


def test_a_phrase_is_spelled_by_few_tasks(spark, monkeypatch):
    """Rows that spell frequent phrases follow the phrases, not the tasks; what
    the drawn documents do not show is found as well."""
    rows = [("the new york city hall is new. " * 3, "en")] * 400 + [("rare words meet here, " * 20, "fr"), ("ab ba " * 70, None)]
    made = []
    real = C._examples
    monkeypatch.setattr(C, "_examples", lambda *a: made.append(a[1]) or real(*a))
    df = frame(spark, rows).repartition(40)
    for from_ in (C.SPELL_FROM, 0):
        monkeypatch.setattr(C, "SPELL_FROM", from_)
        got = sorted(tuple(r) for r in C.collocations(spark, df, least=20).collect())
        assert got == brute(rows, 20) and len(got) > 5
    assert [m[0] for m in made] == [0.2, 0.0] and made[0][3] == 0.2 / 64


def test_a_hash_of_two_phrases_is_counted_by_words(spark, monkeypatch):
    """Where two phrases are seen under one hash, the hash tells neither."""
    real = C._examples

    def twice(*args):
        run = real(*args)

        def both(batches):
            for b in run(batches):
                yield b
                yield b.set_column(3, "phrase", b.column("lang"))
        return both
    monkeypatch.setattr(C, "_examples", twice)
    rows = corpus(6)
    got = sorted(tuple(r) for r in C.collocations(spark, frame(spark, rows), least=12).collect())
    assert got == brute(rows, 12) and len(got) > 20
