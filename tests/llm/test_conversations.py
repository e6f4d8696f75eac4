"""Repaired conversations against brute force."""

import hashlib
import random
import re
from functools import lru_cache
from itertools import product
from zlib import crc32

import pytest

from leadfit.llm import conversations as c
from leadfit.llm.registry import op12_conversation_repair

SMALL = "/root/testdata/sf0.01"
PATTERN = re.compile(r"(s?(ua)+)?")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    """First fault of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        visible = text.strip(SPACES)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) and the repaired rows, by recursion over what is left."""
    faults = faults_of(rows)

    @lru_cache(None)
    def rest(i, before, inserts):
        """before: the last initial, empty at the start; the best of all ways to go on."""
        found = []
        if i == len(rows) and before in ("", "a"):
            found.append((0, "", ()))
        follows = {"": "u", "s": "u", "u": "a", "a": "u"}[before]
        name = {"u": "user", "a": "assistant"}[follows]
        if inserts < 3:
            cost, audit, lines = rest(i, follows, inserts + 1)
            found.append((cost + 5, "I" + audit, (name + ":", *lines)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, lines = rest(i + 1, before, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                cost, audit, lines = rest(i + 1, follows, 0)
                found.append((cost + 1 + more, "R" + audit, (f"{name}:{text}", *lines)))
                if role[:1] and (role[0] == follows or before == "" and role[0] == "s"):
                    cost, audit, lines = rest(i + 1, role[0], 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return rest(0, "", 0)


def plain_row(rows):
    """Expected line of a conversation from its rows (turn, role, text) in order."""
    faults = faults_of([r[1:] for r in rows])
    cost, audit, lines = plain_repair(tuple(r[1:] for r in rows))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return sorted(rows, key=key)


def plain_damage(rows):
    """conv_id -> rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(case, 1))
    return {k: plain_order(v) for k, v in out.items()}


def all_repairs(rows):
    """Every repair with at most two insertions at a place, by trying all."""
    best = (10**9, "")
    for letters in product("DKR", repeat=len(rows)):
        for inserts in product(range(3), repeat=len(rows) + 1):
            audit, cost, initials = "", 0, [[]]
            for i, (initial, fault) in enumerate(rows):
                audit += "I" * inserts[i] + letters[i]
                cost += 5 * inserts[i]
                initials = [x + list(t) for x in initials for t in product("ua", repeat=inserts[i])]
                if letters[i] != "D" and fault in (c.BLANK, c.DUPLICATE):
                    break
                cost += {"D": 2, "K": 0, "R": 1}[letters[i]] + 5 * (letters[i] != "D" and fault == c.TRUNCATED)
                initials = [x + [t] for x in initials for t in {"D": [""], "K": [initial], "R": "ua"}[letters[i]]]
            else:
                audit += "I" * inserts[-1]
                cost += 5 * inserts[-1]
                if (cost, audit) < best and any(PATTERN.fullmatch("".join(x) + "".join(t)) for x in initials for t in product("ua", repeat=inserts[-1])):
                    best = (cost, audit)
    return best


def test_search_finds_the_best_of_all_repairs():
    r = random.Random(1)
    for n in range(4):
        for _ in range(25):
            rows = [(r.choice("suax"), r.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(n)]
            assert c.cheapest(rows) == all_repairs(rows), rows


def test_search_of_long_and_of_hostile_conversations():
    r = random.Random(2)
    for rows in (
        [("s", 0)] * 300, [("u", 0)] * 301, [("a", 3)] * 300, [("u", 3), ("a", 0)] * 150, [("x", 0)] * 299,
        [(r.choice("sua"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(400)], [(r.choice("ssua"), 0) for _ in range(300)],
    ):
        text = {c.FINE: "x{}.", c.BLANK: "", c.TRUNCATED: "x{}"}
        named = []
        for i, (initial, fault) in enumerate(rows):
            named.append((initial, text[fault].format(i)) if fault != c.DUPLICATE else ("u", "again."))
        faults = [{"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for f in faults_of(named)]
        import sys
        sys.setrecursionlimit(20_000)
        assert c.cheapest([(i, f) for (i, _), f in zip(named, faults)]) == plain_repair(tuple(named))[:2]


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("segment", [c.SEGMENT, 7])
def test_conversations_as_brute_force(spark, monkeypatch, segment):
    """Odd rows: nulls, ties, repeated rows, other roles, long conversations, also cut into segments."""
    monkeypatch.setattr(c, "SEGMENT", segment)
    r = random.Random(4)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "ü", "sudo"]
    texts = ["Hello there.", "Why?", "and then", "", " \t\n", None, "Fine!  ", "ends here.\x0b", "no ", " ", "a.b"]
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, 3]), r.choice(roles[:2] * 8 + roles), r.choice(texts[:2] * 6 + texts) if r.random() < 0.5 else f"{turn} {r.choice(texts)}"))
    rows += [(None, t, "user", "x.") for t in (1, 2, None)] + [(100, None, None, None)] * 3
    rows += [(101, t, ["user", "assistant"][t % 2 ^ (t % 9 == 4)], f"turn {t}" + "." * (t % 5 > 0)) for t in range(120)]
    rows += [(102, 5, "user", "Same again.")] * 40
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "lost", 7) for x in rows], "conv_id long, turn long, role string, text string, audit string, line int")
    plain = {}
    for conv, turn, role, text in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {k: plain_row(plain_order(v)) for k, v in plain.items()}
    repaired = c.repair_conversations(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert collected(repaired) == want
    lines = {}
    for x in c.repaired_rows(df, repaired).orderBy("conv_id", "position").collect():
        lines.setdefault(x["conv_id"], []).append((x["position"], f"{x['role']}:{x['text']}"))
    for conv, row in want.items():
        got = lines.get(conv, [])
        assert [p for p, _ in got] == [*range(len(got))]
        assert hashlib.sha256("\n".join(x for _, x in got).encode()).hexdigest() == row[-1]


def test_query_as_brute_force(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {k: plain_row(v) for k, v in plain_damage([tuple(r) for r in given]).items()}
    assert collected(op12_conversation_repair(spark, SMALL)) == want
    assert {letter for row in want.values() for letter in row[-2]} >= set("DKR")


def test_damage_and_empty_tables(spark):
    rows = [(k % 7 if k % 11 else None, k if k % 5 else None, "assistant" if k % 3 else None, "One. Two! Three?" if k % 4 else None) for k in range(200)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in c.damaged(df).collect()), key=repr)
    assert got == sorted(((k, *r) for k, v in plain_damage(rows).items() for r in v), key=repr)
    nothing = spark.createDataFrame([], schema)
    assert c.repair_conversations(c.damaged(nothing), nothing).count() == 0
    gone = c.repair_conversations(nothing, spark.createDataFrame([(1,), (None,), (1,)], "conv_id long"))
    assert collected(gone) == {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, None)}
