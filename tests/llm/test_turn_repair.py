import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohort_engine.llm import queries as Q
from cohort_engine.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string, part int, edit string, cost double, conv string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in rows], SCHEMA)


def faults(rows):
    """(role, text, fault) of one conversation's rows, in order."""
    seen, out = set(), []
    for role, text in rows:
        visible = text.strip("\t\n\x0b\x0c\r ")
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        if visible:
            seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows):
    """Cheapest (cost, audit, repaired rows), one row at a time."""
    ways = {"": (0, "", ())}                     # last role initial -> best
    nxt = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def closed(w):
        out = dict(w)
        for _ in range(2):
            for st, (c, a, o) in list(out.items()):
                to, name = nxt[st]
                new = (c + 2, a + "I", o + (name + ":",))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for role, text, fault in rows:
        new = {}

        def put(st, way):
            if st not in new or way[:2] < new[st][:2]:
                new[st] = way
        extra = fault == "truncated"
        for st, (c, a, o) in closed(ways).items():
            put(st, (c + 3, a + "D", o))
            if fault not in ("blank", "duplicate"):
                if role[:1] == "s" and st == "":
                    put("s", (c + extra, a + "K", o + (f"{role}:{text}",)))
                to, name = nxt[st]
                if role[:1] == to:
                    put(to, (c + extra, a + "K", o + (f"{role}:{text}",)))
                put(to, (c + 2 + extra, a + "R", o + (f"{name}:{text}",)))
        ways = new
    return min((w for st, w in closed(ways).items() if st in ("", "a")), key=lambda w: w[:2])


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        marked = faults([r[1:] for r in own])
        known = [r[0] for r in own if r[0] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        n = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        cost, audit, lines = plain(marked)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spark_result(spark, rows, **kw):
    done = T.repair(spark, turns(spark, rows), **kw)
    report = {r[0]: tuple(r)[1:] for r in done.report.collect()}
    hashes = {r[0]: r[1] for r in T.text_hashes(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {c: (*v, hashes.get("null" if c is None else f"={c}", empty)) for c, v in report.items()}


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "cut", "", " \t", None, "Three? ", "é"]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    return [(c, rng.choice([None, t, t, t + 5]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"text {rng.random()}.")
            for c in range(convs) for t in range(rng.randrange(1, 12))]


@pytest.mark.parametrize("kw", [{}, {"block_rows": 2}, {"rounds": 0}, {"block_rows": 3, "rounds": 2}])
def test_matches_row_by_row(spark, kw):
    rows = some_rows(5)
    rows += [(None, 1, "user", "No id."), (None, 1, "user", "No id."), (70, 0, "user", "x" * 200_000)]
    assert spark_result(spark, rows, **kw) == brute(rows)


def test_plain_is_the_least_of_all_edits():
    """Every sequence of edits of short conversations, tried in turn."""
    good = {"", *("s" * lead + "ua" * n for lead in (0, 1) for n in (1, 2, 3))}
    for n in range(4):
        for rows in itertools.product([("user", "A."), ("assistant", "b"), ("system", "C."), ("tool", "")], repeat=n):
            marked = faults(rows)
            best = []
            slots = [["", "I", "II"]] * (n + 1)
            for ins in itertools.product(*slots):
                if sum(map(len, ins)) > 4:
                    continue
                for ops in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "R"] for _, _, f in marked]):
                    audit = "".join(i + o for i, o in zip(ins, [*ops, ""]))
                    cost = sum({"I": 2, "D": 3, "K": 0, "R": 2}[x] for x in audit)
                    cost += sum(o != "D" and f == "truncated" for o, (_, _, f) in zip(ops, marked))
                    forms = [""]
                    kept = iter(zip(ops, marked))
                    for x in audit:
                        if x in "DKR":
                            _, (role, _, _) = next(kept)
                        if x != "D":
                            forms = [f + c for f in forms for c in ([role[0]] if x == "K" else "ua")]
                    if any(f in good for f in forms):
                        best.append((cost, audit))
            assert min(best) == plain(marked)[:2], rows


def test_one_long_conversation_over_many_blocks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "", f"{t}", f"{t}."])) for t in range(700)]
    assert spark_result(spark, rows, block_rows=16) == brute(rows)


def test_grammar_is_shared_and_expands(spark):
    seqs = spark.createDataFrame([("EIEIEI", 5), ("EIEIEIEI", 2), ("AEI", 1)], "seq string, n long")
    rules = T.fit_grammar(seqs)
    x, starts = T.compressed(["EIEIEI", "AEI"], rules)
    assert rules and len(starts) == 2 and len(x) < 11

    def spelled(s):
        return chr(T.CODE + s) if s < T.TERMINALS else spelled(rules[s - T.TERMINALS][0]) + spelled(rules[s - T.TERMINALS][1])
    assert "".join("|" if s < 0 else spelled(int(s)) for s in x) == "EIEIEI|AEI|"


def test_overlapping_runs_pair_from_the_left():
    x, _ = T.compressed(["AAAAA", "AABAA"], [(0, 0)])
    assert x.tolist() == [16, 16, 0, -1, 16, 1, 16, -1]


def test_empty_table_and_damage(spark, tmp_path):
    assert T.repair(spark, turns(spark, []).filter("false")).report.count() == 0
    rows = [(c, t, None if t == 3 else "assistant", None if t == 4 else f"{c} {t}. a!") for c in range(30) for t in [None, 0, 1, 2, 3, 4]]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in T.damaged(turns(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns(spark, [(lost, 0, "user", "Gone.")]).write.parquet(f"{tmp_path}/conversations.parquet")
    row = Q.op11_turn_repair(spark, str(tmp_path)).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_legal(spark):
    done = T.repair(spark, turns(spark, some_rows(11))).turns.filter("edit <> 'D'")
    forms = (done.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "block", "row", "step", F.substring("role", 1, 1).alias("c")))).alias("x"))
             .select(F.array_join("x.c", "").alias("form")))
    assert forms.filter(~F.col("form").rlike("^(s?(ua)+)?$")).count() == 0 and forms.count()
