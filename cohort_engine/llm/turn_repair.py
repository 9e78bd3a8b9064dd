"""Repair of conversation structure by a grammar-compressed dynamic program.

A row is one symbol, its role's initial (s, u, a, other) and its fault (none,
blank, duplicate, truncated).  Rows are dealt by range of (conversation, turn),
so a long conversation spreads over partitions, and cut into blocks.  The
blocks' symbol sequences are compressed by Re-Pair over all conversations: the
most frequent neighbours become a rule, round after round.  A rule has one
min-plus transfer matrix over the states of ``(s?(ua)+)?``; its entries hold the
least cost and the audit, as a rope of its parts' audits.  Rules are evaluated
bottom-up once and shared; a block is the product of its symbols' matrices,
a conversation the product of its blocks'.

Inserts belong to the row they precede (those after the last row to the end),
so two audits of the same rows are never one the start of the other, and the
ASCII-least audit of a product is made of ASCII-least parts.

The grammar only decides what is shared; results don't depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.llm.store import written

BLOCK_ROWS = 2048               # symbols of a block
ROUNDS = 8                      # Re-Pair rounds
PAIRS_A_ROUND = 32              # rules a round may add
VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# The costs of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1

ROLES = "sua"                   # initials; any other is the last role
FAULTS = ("", "blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NAMES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}     # state after an insert or rerole


class Rope:
    """An audit made of two others; text is read from the leaves."""
    __slots__ = ("left", "right", "text")

    def __init__(self, left=None, right=None, text=""):
        self.left, self.right, self.text = left, right, text

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                if x.text:
                    yield x.text
            else:
                stack.append(x.right)
                stack.append(x.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: "Rope") -> bool:
        """By characters; neither starts with the other."""
        if self is other:
            return False
        mine, theirs = self.leaves(), other.leaves()
        a = b = ""
        while True:
            a, b = a or next(mine, ""), b or next(theirs, "")
            n = min(len(a), len(b))
            if a[:n] != b[:n] or n == 0:
                return a < b
            a, b = a[n:], b[n:]


Entry = tuple[int, Rope] | None


def inserted(p: int) -> dict[int, tuple[int, str]]:
    """state -> (cost, audit) of inserts alone, from state p."""
    out = {p: (0, "")}
    cost, audit, q = 0, "", p
    for _ in range(2):
        cost, audit, q = cost + INSERT, audit + "I", AFTER[q]
        out.setdefault(q, (cost, audit))
    return out


@dataclass
class Part:
    """What a symbol, rule or block is: its matrix (from state, to state), its
    faults' counts, illegal neighbours, first and last role."""
    matrix: list[list[Entry]]
    faults: tuple[int, int, int]
    illegal: int
    first: str
    last: str


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def terminal(symbol: int) -> Part:
    role, fault = divmod(symbol, len(FAULTS))
    initial = (ROLES + "?")[role]
    extra = LEFT_TRUNCATED if FAULTS[fault] == "truncated" else 0
    matrix: list[list[Entry]] = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        for q, (cost, audit) in inserted(p).items():
            ends = [(q, DELETE, "D")]
            if FAULTS[fault] not in ("blank", "duplicate"):
                keep = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
                if keep == SYSTEM and q == START or keep in NAMES and AFTER[q] == keep:
                    ends.append((keep, extra, "K"))
                ends.append((AFTER[q], REROLE + extra, "R"))
            for to, more, letter in ends:
                new = (cost + more, audit + letter)
                old = matrix[p][to]
                if old is None or new < (old[0], old[1].text):
                    matrix[p][to] = (new[0], Rope(text=new[1]))
    return Part(matrix, tuple(int(FAULTS[fault] == f) for f in FAULTS[1:]), 0, initial, initial)


def better(new: Entry, old: Entry) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and new[1] < old[1]


def times(x: Part, y: Part) -> Part:
    """The part that is x followed by y."""
    matrix: list[list[Entry]] = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        for mid in range(STATES):
            head = x.matrix[p][mid]
            if head is None:
                continue
            for q in range(STATES):
                tail = y.matrix[mid][q]
                if tail is not None:
                    new = (head[0] + tail[0], Rope(head[1], tail[1]))
                    if better(new, matrix[p][q]):
                        matrix[p][q] = new
    return Part(matrix, tuple(a + b for a, b in zip(x.faults, y.faults)),
                x.illegal + y.illegal + (not legal(x.last, y.first)), x.first, y.last)


TERMINALS = (len(ROLES) + 1) * len(FAULTS)
CODE = ord("A")                 # symbol n is written chr(CODE + n)


def evaluated(rules: list[tuple[int, int]]) -> list[Part]:
    """Terminals and rules, bottom-up."""
    parts = [terminal(s) for s in range(TERMINALS)]
    for a, b in rules:
        parts.append(times(parts[a], parts[b]))
    return parts


def compressed(sequences: list[str], rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all sequences, -1 after each; start of each)."""
    raw = np.frombuffer("\n".join([*sequences, ""]).encode(), np.uint8)
    x = np.where(raw == 10, -1, raw.astype(np.int64) - CODE)
    for k, (a, b) in enumerate(rules):
        hit = np.zeros(len(x), bool)
        hit[:-1] = (x[:-1] == a) & (x[1:] == b)
        if a == b:                              # of a run, every other one from its start
            at = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) if len(at) else at
            first = at[np.searchsorted(run, run)] if len(at) else at
            hit[at[(at - first) % 2 == 1]] = False
        if hit.any():
            x = np.where(hit, TERMINALS + k, x)[np.concatenate([[True], ~hit[:-1]])]
    ends = np.flatnonzero(x == -1)
    return x, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends


def _pairs(rules: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, starts = compressed(batch.column(0).to_pylist(), rules)
            if not len(starts):
                continue
            weight = np.repeat(np.asarray(batch.column(1)), np.diff(np.append(starts, len(x))))
            own = (x[:-1] >= 0) & (x[1:] >= 0)
            pair, back = np.unique(x[:-1][own] << 32 | x[1:][own], return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, back, weight[:-1][own])
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])
    return run


def fit_grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS_A_ROUND) -> list[tuple[int, int]]:
    """Re-Pair rules from (seq, n).  A round adds the most frequent pairs that
    can't overlap each other; pairs of symbols are as many as the square of the
    terminals and rules at most, so only the best of a bounded table are read."""
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        best = (sequences.select("seq", "n").mapInArrow(_pairs(list(rules)), "a long, b long, n long").groupBy("a", "b")
                .agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(4 * pairs).collect())
        heads, tails, added = set(), set(), 0
        for r in best:
            if added < pairs and r["a"] not in tails and r["b"] not in heads and (r["a"] != r["b"] or not added):
                rules.append((r["a"], r["b"]))
                heads.add(r["a"])
                tails.add(r["b"])
                added += 1
                if r["a"] == r["b"]:
                    break
        if not added:
            break
    return rules


_MATRIX = ("seq string, cost array<int>, rank array<int>, audit array<string>, blank long, duplicate long, truncated long, "
           "illegal long, first string, last string")


def _evaluate(rules: list[tuple[int, int]]):
    """Each distinct sequence as a product of its grammar symbols' matrices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for batch in batches:
            parts = parts or evaluated(rules)
            texts = batch.column(0).to_pylist()
            x, starts = compressed(texts, rules)
            rows = []
            for text, at, to in zip(texts, starts, np.append(starts[1:], len(x))):
                symbols = x[at:to - 1].tolist()
                whole = parts[symbols[0]]
                for s in symbols[1:]:
                    whole = times(whole, parts[s])
                cells = [c for line in whole.matrix for c in line]
                audit = [None if c is None else str(c[1]) for c in cells]
                rank = []
                for p in range(STATES):
                    line = audit[p * STATES:(p + 1) * STATES]
                    rank += [sum(o is not None and a is not None and o < a for o in line) for a in line]
                rows.append({"seq": text, "cost": [-1 if c is None else c[0] for c in cells], "rank": rank, "audit": audit,
                             "blank": whole.faults[0], "duplicate": whole.faults[1], "truncated": whole.faults[2],
                             "illegal": whole.illegal, "first": whole.first, "last": whole.last})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_MATRIX)
    return run


_ARROW_MATRIX = pa.schema([("seq", pa.string()), ("cost", pa.list_(pa.int32())), ("rank", pa.list_(pa.int32())),
                           ("audit", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()),
                           ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])


def path(matrices: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], str]:
    """(cost, state before each block and after the last, final inserts) of the
    cheapest way through the blocks' (cost, rank) tables, ties ASCII-least."""
    ends = [inserted(p) for p in range(STATES)]
    final = [min(e[q] for q in (START, ASSISTANT) if q in e) for e in ends]
    togo = [[c for c, _ in final]]
    for cost, _ in reversed(matrices):
        nxt = togo[-1]
        togo.append([min((cost[p * STATES + q] + nxt[q] for q in range(STATES) if cost[p * STATES + q] >= 0), default=1 << 60)
                     for p in range(STATES)])
    togo.reverse()
    at, states = START, [START]
    for k, (cost, rank) in enumerate(matrices):
        row = range(at * STATES, at * STATES + STATES)
        at = min((cost[c] + togo[k + 1][c - at * STATES], rank[c], c - at * STATES) for c in row if cost[c] >= 0)[2]
        states.append(at)
    return togo[0][START], states, final[at][1]


_CHOICE = ("conv string, part int, block int, before int, after int, tail string, cost long, illegal long")
_ARROW_CHOICE = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int32()),
                           ("after", pa.int32()), ("tail", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States around each block, from blocks sorted by conversation.  Held are
    the 32 small numbers of each block of one conversation.  cost: the
    conversation's, on its last block; illegal: the neighbours over block ends."""
    held: list[dict] = []

    def finish() -> list[dict]:
        cost, states, tail = path([(r["cost"], r["rank"]) for r in held])
        last = len(held) - 1
        return [{"conv": r["conv"], "part": r["part"], "block": r["block"], "before": states[k], "after": states[k + 1],
                 "tail": tail if k == last else "", "cost": cost if k == last else 0,
                 "illegal": int(k > 0 and not legal(held[k - 1]["last"], r["first"]))} for k, r in enumerate(held)]

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and held[0]["conv"] != r["conv"]:
                out += finish()
                held = []
            held.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_CHOICE)
    if held:
        yield pa.RecordBatch.from_pylist(finish(), schema=_ARROW_CHOICE)


_EDIT = "conv string, part int, block int, row int, step int, edit string, new_role string"
_ARROW_EDIT = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("row", pa.int32()),
                         ("step", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every edit of a block: the row it concerns or precedes, and the role it
    gives (null: the row keeps its own)."""
    for batch in batches:
        for r in batch.to_pylist():
            state, row, out = r["before"], 0, []
            for step, letter in enumerate(r["audit"]):
                role = None
                if letter in "IR":
                    state = AFTER[state]
                    role = NAMES[state]
                elif letter == "K":
                    state = SYSTEM if r["seq"][row] < chr(CODE + len(FAULTS)) else AFTER[state]
                out.append((row, step, letter, role))
                row += letter != "I"
            n = len(out)
            cols = list(zip(*out)) if n else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv"]] * n, pa.string()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()),
                 pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                schema=_ARROW_EDIT)


def _placed(block_rows: int):
    """Partition, block and row number of rows sorted by conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, at = None, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            places = np.empty(len(keys), np.int64)
            for k, key in enumerate(keys):
                if key != conv:
                    conv, at = key, 0
                places[k] = at
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array((places // block_rows).astype(np.int32)),
                 pa.array((places % block_rows).astype(np.int32))], names=[*batch.schema.names, "part", "block", "row"])
    return run


@dataclass
class Repaired:
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit.  ``turns``: conv_id, part, block, row, step (their order), edit
    (K, R, I, D), role, text: the repaired rows, and the deleted ones (D)."""
    report: DataFrame
    turns: DataFrame


def conversation_key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def repair(spark: SparkSession, turns: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> Repaired:
    """Cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    A row's first fault counts: blank (no visible character), duplicate (role
    and text were seen earlier), truncated (last visible character not one of
    ``.!?``).  Blank and duplicate rows must go.

    Defined cases: null role or text count as one space, a null conv_id is a
    conversation of its own; turns order the rows, nulls first, ties by role
    and then by the text's digest; rows that repeat are duplicates; roles other
    than those with initial s, u, a can only be changed or deleted; a
    conversation without rows has no row in the report; extra columns are left
    out; an empty table gives empty results.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = (turns.select(conversation_key(F.col("conv_id")).alias("conv"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
                         space("role").alias("role"), space("text").alias("text"))
            .withColumn("print", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
            .withColumn("serial", F.monotonically_increasing_id()))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print"), F.col("serial")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("serial")
              .mapInArrow(_placed(block_rows), "conv string, conv_id " + turns.schema["conv_id"].dataType.simpleString()
                          + ", turn long, role string, text string, print string, part int, block int, row int"))
    rows = written(placed, "turns")

    blank = ~F.col("text").rlike(VISIBLE)
    light = rows.select("conv", "turn", "part", "block", "row", "print", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
                        (~F.col("text").rlike(ENDED)).alias("cut"))
    light = written(light, "turn-marks")
    here = F.struct("part", "block", "row")
    seen = (light.filter(~F.col("blank")).groupBy("conv", "print").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first"))
            .filter("n > 1").select("conv", "print", "first"))
    marked = light.join(seen, ["conv", "print"], "left")
    fault = (F.when(F.col("blank"), 1).when(F.col("first").isNotNull() & (here != F.col("first")), 2)
             .when(F.col("cut"), 3).otherwise(0))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.chr(role * len(FAULTS) + fault + CODE)
    blocks = (marked.groupBy("conv", "part", "block").agg(F.array_sort(F.collect_list(F.struct("row", symbol.alias("s")))).alias("all"))
              .select("conv", "part", "block", F.array_join(F.col("all.s"), "").alias("seq")))
    blocks = written(blocks, "turn-blocks")
    sequences = written(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "turn-sequences")
    rules = fit_grammar(sequences, rounds)
    matrices = written(sequences.select("seq").mapInArrow(_evaluate(rules), _MATRIX), "turn-matrices")

    chosen = (blocks.join(matrices.select("seq", "cost", "rank", "first", "last"), "seq")
              .select("conv", "part", "block", "cost", "rank", "first", "last")
              .repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_choose, _CHOICE))
    cell = F.col("before") * STATES + F.col("after") + 1
    chosen = (chosen.withColumnRenamed("illegal", "over").join(blocks, ["conv", "part", "block"])
              .join(matrices.drop("cost", "rank", "first", "last"), "seq")
              .select("conv", "part", "block", "seq", "before", "cost", F.concat(F.element_at("audit", cell), "tail").alias("audit"),
                      "blank", "duplicate", "truncated", (F.col("illegal") + F.col("over")).alias("illegal")))
    chosen = written(chosen, "turn-audits")

    ids = rows.select("conv", "conv_id", "turn").groupBy("conv", "turn").agg(F.first("conv_id").alias("conv_id"))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    gaps = ids.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), span.alias("gaps"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x["audit"]), "")
    totals = chosen.groupBy("conv").agg(*sums, whole.alias("audit"))
    report = gaps.join(totals, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = chosen.select("conv", "part", "block", "seq", "before", "audit").mapInArrow(_edits, _EDIT)
    place = ["conv", "part", "block", "row"]
    fixed = (edits.filter("edit <> 'I'").join(rows.select(*place, "conv_id", "role", "text"), place)
             .select(*place, "step", "edit", "conv_id", F.coalesce("new_role", "role").alias("role"), "text"))
    added = (edits.filter("edit = 'I'").join(gaps.select("conv", "conv_id"), "conv")
             .select(*place, "step", "edit", "conv_id", F.col("new_role").alias("role"), F.lit("").alias("text")))
    return Repaired(report, fixed.unionByName(added).select("conv_id", "part", "block", "row", "step", "edit", "role", "text"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, read one row at a time."""
    conv, now = None, None
    for batch in batches:
        done = []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != conv:
                if now is not None:
                    done.append((conv, now.hexdigest()))
                conv, now = key, hashlib.sha256()
            else:
                now.update(b"\n")
            now.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([now.hexdigest()])], names=["conv", "repaired_sha256"])


def text_hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired ``role:text`` lines.  The hash of
    one conversation is sequential: its rows pass through one task, sorted on
    disk and read as a stream."""
    lines = (repaired.filter("edit <> 'D'")
             .select(conversation_key(F.col("conv_id")).alias("conv"), "part", "block", "row", "step", F.concat("role", F.lit(":"), "text").alias("line")))
    return (lines.repartition("conv").sortWithinPartitions("conv", "part", "block", "row", "step").select("conv", "line")
            .mapInArrow(_hashes, "conv string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after seeded damage: by the crc32 of
    ``conv_id:turn`` mod 20, 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls (but those of conv_id
    and turn themselves) count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    return (conversations.select("conv_id", "turn", space("role").alias("r"), space("text").alias("t"), kind.alias("kind"))
            .filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("r")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")))
