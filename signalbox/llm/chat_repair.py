"""Conversation structure repair: a generalised LR parser over the role grammar that may edit what it reads.

The grammar of role initials is ``(s?(ua)+)?``. Its LR automaton is built from the productions. While rows are read,
all parses live in a graph-structured stack: a node is a state above another node, parses share their lower nodes, and
parses that end in the same node are merged, keeping the one with the least (cost, audit). Before a row any number of
empty turns may be inserted; the row itself is kept, given another role, or deleted.

A conversation may be longer than a task should hold. Rows are sorted over all partitions by conversation and place;
a conversation that crosses partitions is parsed in pieces, each from every node that it may begin at. Costs and the
order of the audits of the pieces decide which parses fit together best. Texts play no part in this: rows are narrow
until the repaired turns are written, and texts are shuffled once.

Why pieces can be compared by the rank of their audits: an audit of n rows holds exactly n letters other than I and
ends with one, so of two different audits of the same rows none begins the other, whatever follows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.llm.common import let_go
from signalbox.session import work_dir

#: Productions: a conversation C, its pairs of turns P. Terminals are small letters.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
#: What the initials that edits may write stand for, and the costs of edits.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Role initials that may follow each other.
LEGAL = ("su", "ua", "au")
#: A parse that costs more than this above the cheapest never wins: the cheapest can insert at most two turns to end a
#: pair, and then follow the other's edits, but for a first s to delete or a first a that needs a u before it.
SLACK = 2 * INSERT + max(DELETE, INSERT)
#: Rows of one turn are ordered by role, by the beginning of their text, and by the digest of both.
BEGINNING = 64
#: Salt of the join that marks repeated turns.
SALT = 16
BLANK = " \t\n\x0b\x0c\r"


class Table(NamedTuple):
    """The automaton as seen between rows: nodes of the stack are numbers, 0 is the empty stack."""

    moves: tuple[dict[str, int], ...]  # node to node by a terminal
    ending: tuple[int, ...]  # inserts that make the conversation whole


@cache
def automaton() -> Table:
    """Nodes reachable between rows, by shifts and the reductions that need no look at what follows."""
    rules = (("S", "C"), *GRAMMAR)
    heads = {h for h, _ in rules}

    def closure(items: set[tuple[int, int]]) -> frozenset:
        while True:
            wanted = {rules[r][1][at] for r, at in items if at < len(rules[r][1])}
            more = {(r, 0) for r, (head, _) in enumerate(rules) if head in wanted} - items
            if not more:
                return frozenset(items)
            items = items | more

    def goto(state: frozenset, symbol: str) -> frozenset | None:
        items = {(r, at + 1) for r, at in state if rules[r][1][at : at + 1] == symbol}
        return closure(items) if items else None

    root = (closure({(0, 0)}), None)  # a node: its state, and the node below

    def pushed(node: tuple, symbol: str) -> tuple | None:
        state = goto(node[0], symbol)
        return None if state is None else (state, node)

    def reduced(node: tuple, rule: int) -> tuple | None:
        head, body = rules[rule]
        for _ in body:
            node = node[1]
        return pushed(node, head)

    def shifted(node: tuple, terminal: str) -> tuple | None:
        node = pushed(node, terminal)
        while node is not None and len(node[0]) == 1:
            ((rule, at),) = node[0]
            if at < len(rules[rule][1]):
                break
            node = reduced(node, rule)
        return node

    def whole(node: tuple | None) -> bool:
        """Whether reductions at the end of the input lead to acceptance."""
        if node is None:
            return False
        complete = [r for r, at in node[0] if at == len(rules[r][1])]
        return 0 in complete or any(whole(reduced(node, r)) for r in complete)

    terminals = sorted({c for _, body in rules for c in body} - heads)
    nodes, moves, at = [root], [], 0
    while at < len(nodes):
        out = {}
        for terminal in terminals:
            if (node := shifted(nodes[at], terminal)) is not None:
                if node not in nodes:
                    nodes.append(node)
                out[terminal] = nodes.index(node)
        moves.append(out)
        at += 1
    ending = []
    for i in range(len(nodes)):
        now, k = {i}, 0
        while not any(whole(nodes[n]) for n in now):
            now, k = {moves[n][x] for n in now for x in ROLES if x in moves[n]}, k + 1
        ending.append(k)
    return Table(tuple(moves), tuple(ending))


@cache
def edits(initial: str, deleted: bool, truncated: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each node the cheapest ways (node, cost, letters) over a row, inserts before it included."""
    moves, _ = automaton()
    kept = TRUNCATED if truncated else 0
    out = []
    for node in range(len(moves)):
        best: dict[int, tuple[int, str]] = {}
        before, now = 0, {node}
        while before <= len(moves):
            lead, cost = "I" * before, INSERT * before
            for at in now:
                ways = [(at, cost + DELETE, lead + "D")]
                if not deleted:
                    ways += [(moves[at][initial], cost + kept, lead + "K")] if initial in moves[at] else []
                    ways += [(moves[at][x], cost + REROLE + kept, lead + "R") for x in ROLES if x in moves[at]]
                for to, *way in ways:
                    best[to] = min(best.get(to, (1 << 60, "")), tuple(way))
            now, before = {moves[at][x] for at in now for x in ROLES if x in moves[at]}, before + 1
        out.append(tuple((to, cost, letters) for to, (cost, letters) in sorted(best.items())))
    return tuple(out)


@lru_cache(1 << 16)
def advance(tops: tuple, initial: str, deleted: bool, truncated: bool) -> tuple[int, tuple, tuple]:
    """Reads a row with all parses. ``tops`` are (node, cost above the least, rank of the audit).

    Returns what the least cost grew by, the new tops, and for each of them (number of the old top, letters). Costs
    above SLACK are dropped, so there are few different tops and every step is looked up after its first time.
    """
    found: dict[int, tuple[int, int, str, int]] = {}
    for number, (node, cost, rank) in enumerate(tops):
        for to, more, letters in edits(initial, deleted, truncated)[node]:
            way = (cost + more, rank, letters, number)
            if to not in found or way < found[to]:
                found[to] = way
    least = min(way[0] for way in found.values())
    left = {to: way for to, way in found.items() if way[0] <= least + SLACK}
    ranks = {audit: i for i, audit in enumerate(sorted({(rank, letters) for _, rank, letters, _ in left.values()}))}
    order = sorted(left)
    return (
        least,
        tuple((to, left[to][0] - least, ranks[left[to][1:3]]) for to in order),
        tuple((left[to][3], left[to][2]) for to in order),
    )


class Parse:
    """The parses of a piece from one node on; holds one reference a row."""

    def __init__(self, start: int) -> None:
        self.start, self.cost, self.tops, self.back = start, 0, ((start, 0, 0),), []

    def read(self, initial: str, deleted: bool, truncated: bool) -> None:
        grown, self.tops, back = advance(self.tops, initial, deleted, truncated)
        self.cost += grown
        self.back.append(back)

    def ways(self) -> list[tuple[int, int, int, str]]:
        """(start, end, cost, audit) of every parse left."""
        out = []
        for number, (node, cost, _) in enumerate(self.tops):
            letters, i = [], number
            for back in reversed(self.back):
                i, written = back[i]
                letters.append(written)
            out.append((self.start, node, self.cost + cost, "".join(reversed(letters))))
        return out


class Best(NamedTuple):
    cost: int
    steps: list[tuple[int, int]]  # start and end of each piece
    ending: int  # turns inserted at the end


def best_way(pieces: list[list[dict]]) -> Best:
    """The cheapest chain through the pieces' ways (start, end, cost, rank), by cost and then by the audits."""
    tops: dict[int, tuple[int, int]] = {0: (0, 0)}
    backs: list[dict[int, tuple[int, int]]] = []
    for ways in pieces:
        found: dict[int, tuple[int, int, int, int]] = {}
        for w in ways:
            if w["start"] in tops:
                cost, rank = tops[w["start"]]
                way = (cost + w["cost"], rank, w["rank"], w["start"])
                found[w["end"]] = min(found.get(w["end"], way), way)
        ranks = {audit: i for i, audit in enumerate(sorted({way[1:3] for way in found.values()}))}
        backs.append({end: (way[3], end) for end, way in found.items()})
        tops = {end: (way[0], ranks[way[1:3]]) for end, way in found.items()}
    _, ending = automaton()
    cost, _, node = min((cost + INSERT * ending[node], rank, node) for node, (cost, rank) in tops.items())
    steps, at = [], node
    for back in reversed(backs):
        steps.append(back[at])
        at = back[at][0]
    return Best(cost, steps[::-1], ending[node])


def _narrow(df: DataFrame, conversation: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """The columns that count, under names of their own; a null role or text is one space."""
    there = F.lit(True) if present is None else F.coalesce(F.col(f"`{present}`"), F.lit(False))
    given = df.select(
        F.col(f"`{conversation}`").alias("c"), F.col(f"`{turn}`").cast("bigint").alias("t"), there.alias("there"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("r"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("x"),
    )
    said = F.rtrim(F.col("x"), F.lit(BLANK))
    marks = {
        "t": F.col("t"), "r": F.col("r"), "k": F.left("x", F.lit(BEGINNING)),
        "d": F.unhex(F.sha2(F.concat(F.col("r"), F.lit("\n"), F.col("x")).cast("binary"), 256)),
        "blank": said == "", "truncated": ~F.right(said, F.lit(1)).isin(".", "!", "?"),
    }
    # A row that isn't there only makes its conversation known.
    return given.select("c", "there", "x", *[F.when(F.col("there"), m).alias(n) for n, m in marks.items()])


def _ordered(*before: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*before, "t", "r", "k", "d")]


PIECE = (
    "piece int, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, turns bigint"
)
WAYS = "array<struct<start:int,end:int,cost:bigint,rank:int,audit:string>>"


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for each conversation and partition of the sorted rows: its counts, and its ways with their audits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema["c"], *T._parse_datatype_string(f"{PIECE}, ways {WAYS}").fields])
    arrow = to_arrow_schema(schema)
    starts = range(len(automaton().moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        piece = TaskContext.get().partitionId()
        out: list[dict] = []
        held: dict | None = None
        parses: list[Parse] = []

        def end() -> None:
            ways = [w for p in parses for w in p.ways()]
            rank = {audit: i for i, audit in enumerate(sorted({w[3] for w in ways}))}
            out.append(held | {"ways": [{"start": a, "end": b, "cost": c, "rank": rank[s], "audit": s} for a, b, c, s in ways]})

        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held["c"] != row["c"]:
                    if held is not None:
                        end()
                    # Only the first conversation of a partition may have begun before it.
                    parses = [Parse(s) for s in starts] if held is None else [Parse(0)]
                    held = dict.fromkeys(arrow.names) | {"c": row["c"], "piece": piece}
                    held |= dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
                if row["r"] is None:  # says only that the conversation exists
                    continue
                copies, initial, t = row["n"], row["r"][:1], row["t"]
                fresh = row["fresh"] and not row["blank"]
                held["illegal"] += (held["n"] > 0 and held["last"] + initial not in LEGAL) + (copies - 1) * (2 * initial not in LEGAL)
                if not held["n"]:
                    held["first"] = initial
                held["n"] += copies
                held["last"] = initial
                if row["blank"]:
                    held["blank"] += copies
                else:
                    held["duplicate"] += copies - fresh
                    held["truncated"] += fresh and row["truncated"]
                if t is not None and (held["high"] is None or t != held["high"]):
                    held["low"] = t if held["low"] is None else held["low"]
                    held["high"], held["turns"] = t, held["turns"] + 1
                for p in parses:
                    if fresh:
                        p.read(initial, False, row["truncated"])
                    for _ in range(copies - fresh):
                        p.read(initial, True, False)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if held is not None:
            end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _counts(pieces: list[dict]) -> dict:
    """The counts of a whole conversation from those of its pieces, in order."""
    out = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
    said = [p for p in pieces if p["n"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(said, said[1:]))
    dated = [p for p in pieces if p["turns"]]
    distinct = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    out["gaps"] = dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0
    return out


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _chosen(found: DataFrame) -> DataFrame:
    """Counts and cost of every conversation, and which way to take in each of its pieces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([found.schema["c"], *T._parse_datatype_string(f"{COUNTS}, ending int, steps array<struct<piece:int,start:int,end:int>>").fields])
    arrow = to_arrow_schema(schema)
    light = F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    names = [f.name for f in T._parse_datatype_string(PIECE).fields]
    # As many pieces as partitions that the conversation lies in, not as many as rows.
    whole = found.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*names, light.alias("ways")))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = row["pieces"]
                best = best_way([p["ways"] for p in pieces])
                steps = [{"piece": p["piece"], "start": a, "end": b} for p, (a, b) in zip(pieces, best.steps, strict=True)]
                out.append({"c": row["c"], **_counts(pieces), "cost": best.cost, "ending": best.ending, "steps": steps})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return whole.mapInArrow(run, schema)


class Repair:
    """Repaired conversations; see ``repair``."""

    def __init__(self, given: DataFrame, audits: DataFrame, conversation: str) -> None:
        self.given, self.audits, self.conversation = given, audits, conversation

    def _stream(self) -> DataFrame:
        """Every conversation's audit followed by its rows, in order, in one task; nothing is collected."""
        narrow = [f.name for f in T._parse_datatype_string(f"{COUNTS}, audit string").fields]
        rows = self.given.filter("there").select("c", F.lit(1).alias("kind"), "t", "r", "k", "d", "x", *[F.lit(None).alias(n) for n in narrow])
        heads = self.audits.select("c", F.lit(0).alias("kind"), *[F.lit(None).alias(n) for n in ("t", "r", "k", "d", "x")], *narrow)
        both = heads.unionByName(rows)
        return both.repartition("c").sortWithinPartitions(*_ordered("c", "kind")).select("c", "kind", "t", "r", "x", *narrow)

    def _map(self, fields: str, whole: bool) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        stream = self._stream()
        named = T.StructField(self.conversation, stream.schema["c"].dataType)
        schema = T.StructType([named, *T._parse_datatype_string(fields).fields])
        arrow, key = to_arrow_schema(schema), self.conversation
        # Columns are set by place: the conversation's own name may be that of another column.
        places = range(len(arrow))

        def table(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow[i].type) for i in places], schema=arrow)

        def turns(row: dict, letters: deque) -> Iterator[tuple]:
            """What one row becomes: inserted turns before it, then itself; (edit, turn, role, text)."""
            while (letter := letters.popleft()) == "I":
                yield letter, None, None, ""
            yield letter, row["t"], row["r"], row["x"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            out: list[list] = []
            head, letters, last, place, digest = None, deque(), "", 0, hashlib.sha256()

            def said(turn: tuple) -> None:
                nonlocal last, place
                letter, number, role, text = turn
                if letter == "D":
                    return
                if letter != "K":  # the grammar leaves one choice: u after a or at the beginning, a after u
                    role = ROLES["a" if last == "u" else "u"]
                last = role[:1]
                if whole:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                else:
                    out.append([head["c"], place, number, role, text, letter])
                place += 1

            def end() -> None:
                while letters:
                    said((letters.popleft(), None, None, ""))
                if whole:
                    out.append([head["c"], *[head[n] for n in arrow.names[1:-1]], digest.hexdigest()])

            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        if head is not None:
                            end()
                        head, letters, last, place, digest = row, deque(row["audit"]), "", 0, hashlib.sha256()
                        continue
                    for turn in turns(row, letters):
                        said(turn)
                if len(out) > 2000:
                    yield table(out)
                    out = []
            if head is not None:
                end()
            if out:
                yield table(out)

        return stream.mapInArrow(run, schema)

    def summary(self) -> DataFrame:
        """One row for each conversation: the counts, cost, audit, and the digest of the repaired turns."""
        return self._map(f"{COUNTS}, audit string, repaired_sha256 string", whole=True)

    def turns(self) -> DataFrame:
        """The repaired turns: place from 0, the turn number (null if inserted), role, text and edit (K, R or I)."""
        return self._map("place bigint, turn bigint, role string, text string, edit string", whole=False)


def repair(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> Repair:
    """Repairs the turns of every conversation at the least cost; ``present`` names a boolean column, false for rows
    that only make their conversation known.

    Rows stand by turn (nulls first), then role, the first BEGINNING characters of the text, and the digest of both.
    A row's first fault counts: blank (only BLANK characters), duplicate (role and text stood earlier in the
    conversation), truncated (the last other character isn't ``.``, ``!`` or ``?``). Blank and duplicate rows must
    be deleted, truncated ones cost more when they stay. Among the cheapest repairs the audit that is least in ASCII
    wins; the audit lists the edits' initials in order (Keep, Rerole, Delete, Insert).

    gaps are missing turn numbers, illegal are neighbouring role initials that can't follow each other, both before
    the repair. Null conversations are one conversation; a null role or text is one space; a role that is empty or
    begins with another letter must change or go; repeated rows are duplicates; texts of any length are digested as
    they pass. A conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives
    no rows; other columns, whatever their names, play no part.

    The digest and the audit of one conversation are single values over all its rows, so one task reads those rows
    once, in order, without holding them.
    """
    given = _narrow(df, conversation, turn, role, text, present)
    marks = given.drop("x", "there")
    counted = marks.groupBy("c", "t", "r", "k", "d").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # Where a turn stands in several places, the first of them; repeats at one turn are already one row.
    when = F.struct(F.col("t").isNotNull(), "t")
    first = counted.filter("r is not null and not blank").groupBy("c", "d").agg(F.min(when).alias("at"), F.count(F.lit(1)).alias("places"))
    first = first.filter("places > 1").select(F.col("c").alias("c1"), F.col("d").alias("d1"), F.col("at")["t"].alias("t1"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s1"))
    salt = F.pmod(F.xxhash64("t"), F.lit(SALT)).cast("int")
    match = F.col("c").eqNullSafe(F.col("c1")) & (F.col("d") == F.col("d1")) & (salt == F.col("s1"))
    marked = counted.join(first, match, "left").select("c", "t", "r", "k", "d", "n", "blank", "truncated", (F.col("d1").isNull() | F.col("t").eqNullSafe(F.col("t1"))).alias("fresh"))
    # The digest is the last of the keys, so equal keys are one row and no range is larger than a fair share.
    ranged = marked.repartitionByRange(*_ordered("c")).sortWithinPartitions(*_ordered("c")).drop("k", "d")
    spark, folder = df.sparkSession, work_dir(df.sparkSession, "chat-repair")
    _pieces(ranged).write.parquet(folder)
    found = spark.read.parquet(folder)
    chosen = _chosen(found)
    names = [f.name for f in T._parse_datatype_string(COUNTS).fields]
    steps = chosen.select("c", *names, "ending", F.explode("steps").alias("step")).select("c", *names, "ending", "step.*")
    ways = found.select(F.col("c").alias("c1"), F.col("piece").alias("p1"), "ways")
    taken = steps.join(ways, F.col("c").eqNullSafe(F.col("c1")) & (F.col("piece") == F.col("p1")))
    audit = F.filter("ways", lambda w: (w["start"] == F.col("start")) & (w["end"] == F.col("end")))[0]["audit"]
    audits = taken.groupBy("c").agg(
        *[F.first(n).alias(n) for n in (*names, "ending")], F.sort_array(F.collect_list(F.struct("piece", audit.alias("audit")))).alias("parts")
    )
    letters = F.concat(F.array_join(F.transform("parts", lambda p: p["audit"]), ""), F.repeat(F.lit("I"), F.col("ending")))
    return Repair(given, audits.select("c", *names, letters.alias("audit")), conversation)


def damage(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, for tests and figures: conversation, turn, role, text, present.

    Nulls of role, text and the hashed key are one space. By crc32 of ``conversation:turn`` modulo 20: 0 drops the row
    (present is false), 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    """
    written = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(written(conversation), F.lit(":"), written(turn)).cast("binary")) % 20
    return df.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.when(fault == 4, "user").otherwise(written(role)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(written(text), ".!?", "")).otherwise(written(text)).alias("text"),
        (fault != 0).alias("present"), F.when(fault == 3, 2).otherwise(1).alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
