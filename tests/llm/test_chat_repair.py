"""Conversation repair against plain versions of its rules."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from signalbox.llm import chat_repair
from signalbox.llm.queries import op13_repair

DATA = "/root/testdata/sf0.001"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit) by a search over whole strings; rows are (initial, must go, truncated)."""

    def inserted(best):
        todo = list(best)
        while todo:
            at = todo.pop()
            for x in set("ua") & NEXT[at].keys():
                way, to = (best[at][0] + 3, best[at][1] + "I"), NEXT[at][x]
                if to not in best or way < best[to]:
                    best[to] = way
                    todo.append(to)
        return best

    best = {0: (0, "")}
    for initial, gone, truncated in rows:
        found = {}
        for at, (cost, audit) in inserted(dict(best)).items():
            ways = [(at, cost + 4, audit + "D")]
            if not gone:
                ways += [(NEXT[at][initial], cost + 3 * truncated, audit + "K")] if initial in NEXT[at] else []
                ways += [(NEXT[at][x], cost + 3 + 3 * truncated, audit + "R") for x in "ua" if x in NEXT[at]]
            for to, *way in ways:
                found[to] = min(found.get(to, (1 << 30, "")), tuple(way))
        best = found
    return min(way for at, way in inserted(dict(best)).items() if at in (0, 3))


def exhaustive(rows, most=4):
    """The same by trying every sequence of edits."""
    best = None
    stack = [(0, "", "", 0)]
    while stack:
        i, audit, out, cost = stack.pop()
        if best is not None and (cost, audit) > best and cost >= best[0]:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        if audit.count("I") < most:
            stack += [(i, audit + "I", out + x, cost + 3) for x in "ua"]
        if i < len(rows):
            initial, gone, truncated = rows[i]
            stack.append((i + 1, audit + "D", out, cost + 4))
            if not gone:
                stack.append((i + 1, audit + "K", out + initial, cost + 3 * truncated))
                stack += [(i + 1, audit + "R", out + x, cost + 3 + 3 * truncated) for x in "ua"]
    return best


def parsed(rows, cuts=()):
    ends = [0, *sorted(cuts), len(rows)]
    pieces = []
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        parses = [chat_repair.Parse(s) for s in (range(len(chat_repair.automaton().moves)) if k else [0])]
        for row in rows[a:b]:
            for p in parses:
                p.read(*row)
        ways = [w for p in parses for w in p.ways()]
        rank = {w[3]: i for i, w in enumerate(sorted(ways, key=lambda w: w[3]))}
        pieces.append([{"start": s, "end": e, "cost": c, "rank": rank[x], "audit": x} for s, e, c, x in ways])
    best = chat_repair.best_way(pieces)
    audit = "".join(next(w["audit"] for w in p if (w["start"], w["end"]) == s) for p, s in zip(pieces, best.steps, strict=True))
    return best.cost, audit + "I" * best.ending


def some_rows(rnd, most):
    return [(rnd.choice("sssuuuuaaat"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randrange(most + 1))]


def test_plain_versions_agree():
    rnd = random.Random(3)
    for _ in range(60):
        rows = some_rows(rnd, 4)
        assert exhaustive(rows) == cheapest(rows)


def test_parser_finds_the_cheapest_audit_however_it_is_cut():
    rnd = random.Random(5)
    for _ in range(1500):
        rows = some_rows(rnd, 14)
        cuts = [rnd.randrange(len(rows) + 1) for _ in range(rnd.randrange(4))]
        assert parsed(rows, cuts) == cheapest(rows)


def plain_repair(rows):
    """Everything of one conversation's rows (turn, role, text), in order of turn, role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(marked)
    out, left, last = [], iter(rows), ""
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(left)[1:]
        if letter == "D":
            continue
        role = role if letter == "K" else ROLES["a" if last == "u" else "u"]
        last = role[0]
        out.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    return {**counts, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        held = out.setdefault(conv, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held += [] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {conv: plain_repair(rows) for conv, rows in out.items()}


def summaries(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r.pop("conv_id"): r for r in rows}


def test_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summaries(op13_repair(spark, DATA)) == damaged(rows)


SCHEMA = "conv_id int, turn int, role string, text string, c string, there int, audit int"
EDGES = [
    (1, 0, "user", "Hi.", "x", 1, 1), (1, 1, "assistant", "Well!", "x", 1, 1), (1, 1, "assistant", "Well!", "x", 1, 1), (1, 4, "user", "so", "x", 1, 1),
    (2, None, "user", None, None, None, None), (2, None, None, "a.", None, None, None), (None, 1, "user", "b.", None, None, None), (None, 3, "tool", "c?", None, None, None),
    (3, 1, "", "d.", "x", 1, 1), (3, 2, "user", "", "x", 1, 1), (3, 3, "user", " \t\n", "x", 1, 1), (4, 7, "system", "A long one. " * 50_000, "x", 1, 1),
]


def test_edges(spark):
    given = spark.createDataFrame(EDGES, SCHEMA)
    space = lambda v: " " if v is None else v
    want = {}
    for conv in {r[0] for r in EDGES}:
        want[conv] = plain_repair([(r[1], space(r[2]), space(r[3])) for r in EDGES if r[0] == conv])
    assert summaries(chat_repair.repair(given).summary()) == want
    assert chat_repair.repair(given.filter("false")).summary().collect() == []
    assert chat_repair.repair(given.filter("false")).turns().collect() == []
    known = summaries(chat_repair.repair(given.withColumn("there", F.lit(False)), present="there").summary())
    nothing = hashlib.sha256(b"").hexdigest()
    assert known.keys() == want.keys() and all((r["cost"], r["audit"], r["repaired_sha256"], r["gaps"]) == (0, "", nothing, 0) for r in known.values())


def test_turns_are_what_the_digest_is_of(spark):
    given = spark.createDataFrame(EDGES, SCHEMA)
    repaired = chat_repair.repair(given)
    said = {}
    for r in sorted(repaired.turns().collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repaired.summary().collect():
        assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


@pytest.mark.parametrize("partitions", (1, 3, 7))
def test_long_conversation_over_many_partitions(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(k, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", "", "Why not?", f"It is {t}."])) for k, n in ((1, 3), (2, 900), (3, 4)) for t in range(n)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = summaries(chat_repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).summary())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {k: plain_repair([r[1:] for r in rows if r[0] == k]) for k in (1, 2, 3)}
