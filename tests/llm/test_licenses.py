import random
import re

from cohort_engine.llm import licenses as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = WORDS.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    hits = [(i, label) for phrase, label in L.BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places_match_brute_force(spark, documents):
    rng = random.Random(1)
    vocab = "cc by general public license all rights reserved É x2 CC All -- . é".split()
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1, "cc by cc-by CC  BY"), (None, "cc by"), (7, None), (8, ""), (9, "word " * 30000 + "all rights reserved")]
    got = L.scan_licenses(spark, documents(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) \
        == sorted(((i, *brute_base(t)) for i, t in rows), key=key)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


def test_notices_with_changed_words(spark, documents):
    mit = L.NOTICES[3][0].split()
    less, more = mit[:7] + mit[8:], mit[:9] + ["hereinafter"] + mit[9:]
    rows = [(1, "x y " + " ".join(mit).upper() + " z"), (2, " ".join(less)), (3, " ".join(more)), (4, " ".join(mit[:6])),
            (5, " ".join(w for x in mit for w in (x, "gap", "gap", "gap"))), (6, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in L.scan_licenses(spark, documents(rows)).collect()}
    assert got == {1: ("mit", 0), 2: ("mit", 0), 3: ("mit", 0), 4: ("", 0), 5: ("", 0), 6: ("apache-2.0", 0)}
    assert L.scan_licenses(spark, documents([])).count() == 0


def brute_notices(text):
    """Labels and score by the definition, over all pairs of places."""
    w = WORDS.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    _, n_base, _, _, labels = brute_base(text)
    found, score = set(labels.split(",")) - {""}, 1.0 if n_base else 0.0
    for notice, label in L.NOTICES:
        words = WORDS.findall(notice)
        pairs = len(words) - 1
        hits = [(p, t) for p in range(len(w) - 1) for t in range(pairs) if w[p:p + 2] == words[t:t + 2]]
        diagonals = sorted({p - t for p, t in hits})
        runs = []
        for d in diagonals:
            if runs and d - runs[-1][-1] <= L.GAP:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            for start in run:
                some = sorted((p, t) for p, t in hits if p - t in run and start <= p - t <= start + pairs + L.GAP)
                chain = {}
                for p, t in some:
                    chain[p, t] = 1 + max((n for (a, b), n in chain.items() if a < p and b < t), default=0)
                share = max(chain.values()) / pairs
                if share >= L.COVERAGE:
                    found.add(label)
                    score = max(score, share)
    return ",".join(sorted(found)), score


def test_labels_and_score_match_brute_force(spark, documents):
    rng = random.Random(4)
    texts = ["licensed under " * 40 + "the apache license version 2.0", "apache license version 2.0 licensed under the",
             " ".join(reversed(L.NOTICES[0][0].split())), "", None, "word " * 20000 + L.NOTICES[2][0] + " tail" * 20000]
    for _ in range(250):
        text = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(L.NOTICES)[0].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = rng.choice([[], ["x"], [words[at]], words[at:at + 2] * 2, ["the"]])
                words = words or ["x"]
            cut = rng.randrange(len(words))
            text += rng.choice([words, words[cut:] + words[:cut]]) + ["y"] * rng.randint(0, 3)
        texts.append(" ".join(text))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan_licenses(spark, documents(list(enumerate(texts)))).collect()}
    want = {i: brute_notices(t) for i, t in enumerate(texts)}
    assert got == want
    assert want[0] == ("apache-2.0", 1.0) and want[1] == want[2] == ("", 0.0)
    assert len({x for x, _ in want.values()}) > 8
