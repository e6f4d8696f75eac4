"""Repair of the order of roles in conversations, at least cost, by depth-first branch-and-bound.

The rows of a conversation, by turn, are kept, given another role or deleted, and empty turns are inserted, until the
initials of the roles read `(s?(ua)+)?`: nothing, or an optional system turn and then user and assistant in turn. Of the
cheapest repairs the one counts whose audit (the initials of its edits in order) is least.

A search node is a row together with the state of that pattern. The search keeps an explicit stack and takes the most
promising child first. A bound from below on what the rest of the rows will cost, from the same problem with any number
of system turns allowed at the head, prunes against the best repair found so far; a table keeps for each node the best
prefix that reached it and drops the worse ones. That is exact: two prefixes of equal cost at one node have consumed the
same rows, so neither begins with the other (an insertion more would cost more), and what follows can't change their order.

Long conversations are searched in segments, for each state at either end, so no task holds a conversation whole; the
segments' tables are then joined in order, by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.llm.common import written

SEGMENT = 1024  # rows of a conversation that are searched at once
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role that came last
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = frozenset({START, ASSISTANT})
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EXPECTED = (USER, USER, ASSISTANT, USER)  # state after the only role that may be inserted or given
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED_LEFT = 1, 2, 5, 5  # costs
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = frozenset({"su", "ua", "au"})

Repair = tuple[int, str]  # cost and audit


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state behind) of the edits that consume a row, letters in order."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_LEFT if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            yield "K", more, KEPT[state, initial]
        yield "R", REROLE + more, EXPECTED[state]


def suffix_bounds(rows: Sequence[tuple[str, int]], goals: frozenset[int]) -> list[list[int]]:
    """For each row and state the least cost from there to one of the goals, if system turns at the head cost nothing:
    START and SYSTEM are then one state, so a path of the real problem is one of this, at the same cost."""
    far = 10**15
    relaxed = {START, SYSTEM} & goals

    def with_inserts(cost: list[int]) -> list[int]:
        for _ in range(3):
            cost = [min(c, INSERT + cost[EXPECTED[s]]) for s, c in enumerate(cost)]
        return cost

    bounds = [with_inserts([0 if s in goals or (s < USER and relaxed) else far for s in STATES])]
    for initial, fault in reversed(rows):
        after = bounds[-1]
        here = []
        for s in STATES:
            least = min(cost + after[t] for _, cost, t in edits(s, initial, fault))
            if s < USER and initial == "s" and fault not in (BLANK, DUPLICATE):
                least = min(least, after[START] + (TRUNCATED_LEFT if fault == TRUNCATED else 0))
            here.append(least)
        here[START] = here[SYSTEM] = min(here[START], here[SYSTEM])
        bounds.append(with_inserts(here))
    return bounds[::-1]


def cheapest(rows: Sequence[tuple[str, int]], entry: int = START, goals: frozenset[int] = FINAL) -> Repair:
    """Least (cost, audit) that leads over the rows (initial, fault) from the state entry to one of the goals."""
    bounds = suffix_bounds(rows, goals)
    end = len(rows)
    best: Repair | None = None
    tables: dict[tuple[int, int], Repair] = {}
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if best:
            least = cost + bounds[at][state]
            if least > best[0] or least == best[0] and audit > best[1][:len(audit)]:
                continue
        before = tables.get((at, state))
        if before and before <= (cost, audit):
            continue
        tables[at, state] = cost, audit
        if at == end and state in goals:
            if best is None or (cost, audit) < best:
                best = cost, audit
            continue
        children = [(cost + INSERT + bounds[at][EXPECTED[state]], "I", at, EXPECTED[state], cost + INSERT)]
        if at < end:
            children += [(cost + c + bounds[at + 1][t], letter, at + 1, t, cost + c) for letter, c, t in edits(state, *rows[at])]
        # the last pushed is taken first: the least bound, of equal ones the least letter
        for _, letter, row, t, c in sorted(children, reverse=True):
            stack.append((row, t, c, audit + letter))
    assert best is not None  # inserting and deleting reach every goal but START and SYSTEM, which `reachable` leaves out
    return best


def segment_table(rows: Sequence[tuple[str, int]], entries: Sequence[int], whole: bool) -> list[dict]:
    """The cheapest repairs of a segment between all states; of a whole conversation, the cheapest one to a final state."""
    if whole:
        cost, audit = cheapest(rows)
        return [{"entry": START, "goal": -1, "cost": cost, "audit": audit}]
    out = []
    for entry in entries:
        for goal in STATES:
            # no edit leads to START, and to SYSTEM only a kept row from START
            if goal == START and entry != START or goal == SYSTEM and not (entry == SYSTEM or entry == START and any(i == "s" and f not in (BLANK, DUPLICATE) for i, f in rows)):
                continue
            cost, audit = cheapest(rows, entry, frozenset({goal}))
            out.append({"entry": entry, "goal": goal, "cost": cost, "audit": audit})
    return out


def fault_columns(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last visible character is none of . ! ?"""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, nulls of the last two as one blank, and a hash that stands for the text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc]
SEGMENTS_SCHEMA = (
    "conv_id long, part int, seq int, rows long, first_turn long, last_turn long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first string, last string, repairs array<struct<entry: int, goal: int, cost: long, audit: string>>")


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, copies, fault, next_fault) of equal rows of a conversation, as one row each:
    the first fault of the first copy and of the others. Counts and firsts are aggregated in each task before a shuffle."""
    blank, open_ = fault_columns(F.col("text"))
    alike = written(rows.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max(blank).alias("blank"), F.max(open_).alias("open")), "turns")
    of_turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = alike.groupBy("conv_id", "role", "digest").agg(F.min(of_turn).alias("earliest")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("earliest.turn").alias("earliest"))
    joined = alike.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    seen = ~F.col("turn").eqNullSafe(F.col("earliest"))
    return joined.select(
        "conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "copies",
        F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE).alias("fault"),
        F.when(F.col("blank"), BLANK).otherwise(DUPLICATE).alias("next_fault"))


class _Segment:
    """Rows of one conversation as they stream by, and what is counted of them."""

    def __init__(self, conv_id: int | None, seq: int, known: bool):
        self.conv_id, self.seq, self.known = conv_id, seq, known
        self.rows: list[tuple[str, int]] = []
        self.first_turn = self.last_turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.illegal += bool(self.rows) and self.rows[-1][0] + initial not in LEGAL
        self.rows.append((initial, fault))
        self.faults[fault] += 1

    def result(self, part: int, ended: bool) -> dict:
        whole = self.known and ended and self.seq == 0
        entries = [START] if self.known and self.seq == 0 else STATES
        return {
            "conv_id": self.conv_id, "part": part, "seq": self.seq, "rows": len(self.rows), "first_turn": self.first_turn,
            "last_turn": self.last_turn, "turns": self.turns, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "first": self.rows[0][0], "last": self.rows[-1][0],
            "repairs": segment_table(self.rows, entries, whole),
        }


def segments(rows: DataFrame) -> DataFrame:
    """Segments of all conversations with their tables of repairs. Rows are dealt by ranges of (conversation, turn, ...),
    so a long conversation spreads over tasks; each task cuts what it holds of one into segments of at most SEGMENT rows."""
    columns = ("conv_id", "turn", "role", "digest")
    order = [how(c) for how, c in zip(ORDER, columns)]
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("rows", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")),
        ("first", pa.string()), ("last", pa.string()),
        ("repairs", pa.list_(pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: _Segment | None = None
        for batch in batches:
            out = []
            for conv_id, turn, initial, copies, fault, next_fault in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(copies):
                    if now is None:
                        now = _Segment(conv_id, 0, False)
                    elif now.conv_id != conv_id:
                        out.append(now.result(part, True))
                        now = _Segment(conv_id, 0, True)
                    elif len(now.rows) == SEGMENT:
                        out.append(now.result(part, False))
                        now = _Segment(conv_id, now.seq + 1, now.known)
                    now.add(turn, initial, next_fault if k else fault)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.result(part, False)], schema)

    sorted_ = faulted(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("conv_id", "turn", "initial", "copies", "fault", "next_fault").mapInArrow(run, SEGMENTS_SCHEMA)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Joined:
    """A conversation from its segments, added in order; segments without rows tell nothing."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.reached: dict[int, Repair] = {START: (0, "")}
        self.first_turn = self.last_turn = self.last = None
        self.turns = 0

    def add(self, p: dict) -> None:
        if not p["rows"]:
            return
        for c in self.counts:
            self.counts[c] += p[c]
        self.counts["illegal"] += self.last is not None and self.last + p["first"] not in LEGAL
        self.last = p["last"]
        if p["first_turn"] is not None:
            self.turns += p["turns"] - (self.last_turn == p["first_turn"])
            self.first_turn = p["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = p["last_turn"]
        ahead: dict[int, Repair] = {}
        for r in p["repairs"]:
            if r["entry"] in self.reached:
                cost, audit = self.reached[r["entry"]]
                goal = START if r["goal"] < 0 else r["goal"]
                repair = cost + r["cost"], audit + r["audit"]
                ahead[goal] = min(ahead.get(goal, repair), repair)
        self.reached = ahead

    def result(self) -> dict:
        cost, audit = min(r for state, r in self.reached.items() if state in FINAL)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.first_turn is not None else 0
        return {"conv_id": self.conv_id, **self.counts, "gaps": gaps, "cost": cost, "audit": audit}


def audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, COUNTS..., audit) of every conversation of ids."""
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in SEGMENTS_SCHEMA.split(", ", 13)[4:])]
    empty = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("rows"), *none)
    all_ = segments(rows).unionByName(empty).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Joined | None = None
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if now is None or now.conv_id != p["conv_id"]:
                    if now:
                        out.append(now.result())
                    now = _Joined(p["conv_id"])
                now.add(p)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.result()], schema)

    return all_.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


class _Replay:
    """Applies an audit to the rows of a conversation as they stream by; gives the rows that stand after the repair."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = EXPECTED[self.state]
            yield ROLES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state, role[:1]]
            yield role, text, "K"
        elif letter == "R":
            self.state = EXPECTED[self.state]
            yield ROLES[self.state], text, "R"

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, its line of found before them."""
    head = found.select(F.lit(0).alias("line"), "*", *(F.lit(None).cast(kind).alias(c) for c, kind in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    body = rows.select(F.lit(1).alias("line"), "conv_id", *(F.lit(None).cast("long").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    order = [F.asc_nulls_first("conv_id"), "line", F.asc_nulls_first("turn"), "role", "digest"]
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).drop("turn", "digest")


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, from rows
    (conv_id, turn, role, text).

    Rows stand by turn, null turns first; rows of one turn by role, then by a hash of the text, copies side by side. A
    null role or text is one blank. The first fault of a row counts: blank, duplicate (its role and text came earlier),
    truncated. Kept rows keep their role; of other roles than system, user and assistant the initial alone counts, and
    an empty role fits nowhere. gaps counts the turns missing between the least and the greatest; illegal the
    neighbours whose initials are none of su, ua, au. repaired_sha256 is that of the repaired `role:text` lines.

    A null conv_id is a conversation like any other. ids names further conversations: those without rows have zeros, an
    empty audit and the hash of nothing. An empty table gives an empty one; other columns are ignored.

    The search, the counts and the comparison of rows spread a long conversation over tasks. Its hash can't be split:
    one task reads its rows in order and holds one batch of them and the audit.
    """
    rows = _rows(conversations)
    every = rows.select("conv_id") if ids is None else rows.select("conv_id").union(ids.select(F.col("conv_id").cast("long")))
    found = written(audits(rows, every), "audits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, digest, started = _Replay(""), None, hashlib.sha256(), False

        def take(lines: Iterator[tuple[str, str, str]]) -> None:
            nonlocal started
            for role, text, _ in lines:
                digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                started = True

        for batch in batches:
            out = []
            heads = batch.select(["conv_id", *COUNTS, "audit"]).to_pylist()
            for h, line, role, text in zip(heads, *(batch.column(c).to_pylist() for c in ("line", "role", "text"))):
                if line:
                    take(now.row(role, text))
                    continue
                if head:
                    take(now.end())
                    out.append(head | {"repaired_sha256": digest.hexdigest()})
                now, head, digest, started = _Replay(h["audit"]), h, hashlib.sha256(), False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if head:
            take(now.end())
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    shown = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _beside_audits(rows, found).mapInArrow(run, shown)


def repaired_rows(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of the rows that stand after the repair, from the conversations and the
    result of repair_conversations for them; position counts from 0, edit is K (kept), R (another role) or I (inserted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, position = _Replay(""), None, 0
        names = ["conv_id", "position", "role", "text", "edit"]
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        for batch in batches:
            out = []

            def put(lines: Iterator[tuple[str, str, str]]) -> None:
                nonlocal position
                for x in lines:
                    out.append(dict(zip(names, (conv_id, position, *x))))  # noqa: B023
                    position += 1

            for line, c, audit, role, text in zip(*(batch.column(x).to_pylist() for x in ("line", "conv_id", "audit", "role", "text"))):
                if line:
                    put(now.row(role, text))
                else:
                    put(now.end())
                    now, conv_id, position = _Replay(audit), c, 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        rest = [dict(zip(names, (conv_id, position + k, *x))) for k, x in enumerate(now.end())]
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema)

    found = repaired.select("conv_id", *COUNTS, "audit")
    return _beside_audits(_rows(conversations), found).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults: by crc32 of `conv_id:turn` modulo 20 a row goes (0), loses its text (1) or its . ! ? (2),
    stands twice (3) or gets the role user (4). Nulls are one blank here."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), blank) for c in ("conv_id", "turn")))
    case = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(case == 0, F.array().cast("array<int>")).when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
