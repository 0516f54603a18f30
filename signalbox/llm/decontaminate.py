"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark's words.

The automaton works on word numbers, so one step of the scan is one word of the document. Texts are normalised
bytewise, which keeps offsets: A-Z becomes lower case, every other ASCII character that is neither a letter nor a
digit becomes a space.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import body, keep, keep_others, map_texts, own_prefix
from signalbox.session import work_dir

WINDOW = 13
RUN = "struct<first:int,last:int,start:int,end:int>"
#: Benchmark bytes in one automaton (about 100 times that in memory). A larger benchmark is scanned block by block.
BLOCK_BYTES = 1 << 20

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(text: str) -> bytes:
    """The normalised text, byte for byte as long as the text."""
    return text.encode().translate(_FOLD)


class Scanner:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in fold(text).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in windows.items():
            self.automaton.add_word(key, (len(key), tuple(names)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def __call__(self, text: str) -> tuple[int, list[dict] | None, list[str] | None]:
        """Number of words, runs of hit words with their code points, and the items found."""
        folded = fold(text)
        words = folded.split()
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in words])
        runs: list[list[int]] = []
        found: set[str] = set()
        if not self.empty and any(numbers):
            for last, (size, names) in self.automaton.iter(numbers):
                first = last - size + 1
                found.update(names)
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append([first, last])
        if not runs:
            return len(words), None, None
        spans = [m.span() for m in _WORD.finditer(folded)]
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        at = lambda byte: int(points[byte])
        return len(words), [{"first": a, "last": b, "start": at(spans[a][0]), "end": at(spans[b][1])} for a, b in runs], sorted(found)


class Blocks:
    """The distinct items in blocks of at most ``block_bytes``; an item above it is a block of its own.

    The number of blocks is raised until every block's measured size is within the bound. Several blocks are written
    to the shared folder, and one at a time is fetched.
    """

    def __init__(self, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> None:
        rows = items.distinct()
        size = F.octet_length("text") + F.octet_length("item") + 16
        total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
        self.rows, self.number = rows, max(1, -(-total // block_bytes))
        if self.number == 1:
            return
        while self.number < 4 * count:
            held = rows.groupBy(self._of()).agg(F.sum(size).alias("held"), F.count("*").alias("n"))
            if not held.filter((F.col("held") > block_bytes) & (F.col("n") > 1)).limit(1).count():
                break
            self.number *= 2
        folder = work_dir(rows.sparkSession, "benchmark-blocks")
        rows.withColumn("block", self._of()).repartition("block").write.partitionBy("block").parquet(folder)
        self.rows = rows.sparkSession.read.parquet(folder)

    def _of(self) -> Column:
        return F.pmod(F.xxhash64("item", "text"), F.lit(self.number)).alias("block")

    def fetch(self, block: int) -> list[tuple[str, str]]:
        rows = self.rows if self.number == 1 else self.rows.filter(F.col("block") == block)
        return [tuple(r) for r in rows.select("item", "text").collect()]


def _merged(runs: Column) -> Column:
    """Sorted runs with touching or overlapping ones joined."""
    none = F.expr("cast(array() as array<struct<first:int,last:int,start:int,end:int>>)")

    def join(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        touch = (F.size(done) > 0) & (run["first"] <= last["last"] + 1)
        both = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(run)))

    return F.when(F.size(runs) < 2, runs).otherwise(F.aggregate(F.sort_array(runs), none, join))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_texts: tuple[str, ...] = ("text",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, items (sorted as strings), runs and contaminated.

    A window is ``window`` consecutive words of an item's texts (questions, answers: each text has its own), or
    all words of a shorter one. A word inside any occurrence of a window is hit; runs are maximal runs of hit
    words: struct<first, last, start, end> in words and code points, the last word included, the end exclusive.
    contaminated: some word is hit, and at least one word in twenty.

    Null and empty texts and items have no words; a null item id is the empty string; repeated items count once.
    Input columns of these names are replaced, others stay, whatever their names; an empty benchmark or table gives no
    hits; repeated rows are each scanned for themselves, and a long text as a whole. There is one block of items up to
    ``block_bytes`` of benchmark; beyond it the documents are scanned for one block after the other.
    """
    names = ["n_words", "n_hit", "items", "runs", "contaminated"]
    columns = [F.struct(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), body(t).alias("text")) for t in item_texts]
    blocks = Blocks(benchmark.select(F.inline(F.array(*columns))), block_bytes)
    given = df.select(*keep_others(df, [n for n in names if n.lower() != text.lower()]))
    own = own_prefix(given)
    n, r, i = (own + c for c in "nri")
    if blocks.number == 1:  # the usual case: one pass, and rows don't move
        scanned = _scan(given, text, blocks.fetch(0), window, (n, r, i))
    else:
        scanned = _scan_blocks(given, text, blocks, window, (n, r, i))
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    runs, found = F.coalesce(F.col(r), empty(RUN)), F.coalesce(F.col(i), empty("string"))
    marked = scanned.select(*keep_others(scanned, [n, r, i, *names]), F.col(n).alias("n_words"), runs.alias("runs"), F.array_sort(F.array_distinct(found)).alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return marked.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(df: DataFrame, text: str, block: list[tuple[str, str]], window: int, names: tuple[str, str, str]) -> DataFrame:
    """Adds the number of words, the runs and the items found, null if there are none."""
    key = (uuid.uuid4().hex, window)

    def work() -> Callable[[list[str]], list]:
        scan = keep(key, lambda: Scanner(block, window))  # a Python worker that runs several tasks builds an automaton once
        return lambda texts: [list(c) for c in zip(*map(scan, texts), strict=True)] if texts else [[], [], []]

    n, r, i = names
    return map_texts(df, text, f"{n} bigint, {r} array<{RUN}>, {i} array<string>", work, key)


def _scan_blocks(df: DataFrame, text: str, blocks: Blocks, window: int, names: tuple[str, str, str]) -> DataFrame:
    """The same block by block: one block, one automaton and one pass at a time, and only rows with hits are kept.

    Rows are written with a number, by which their hits come together.
    """
    spark = df.sparkSession
    n, r, i = names
    kept, hits = work_dir(spark, "numbered"), work_dir(spark, "benchmark-hits")
    df.select(F.monotonically_increasing_id().alias(n + "row"), *keep_others(df, [])).write.parquet(kept)
    numbered = spark.read.parquet(kept)
    for b in range(blocks.number):
        narrow = numbered.select(F.col(n + "row").alias("number"), body(text).alias("text"))
        found = _scan(narrow, "text", blocks.fetch(b), window, ("words", "runs", "items"))
        found.filter("runs is not null").select("number", "runs", "items").write.parquet(f"{hits}/block={b}")
    parts = spark.read.schema(f"number bigint, runs array<{RUN}>, items array<string>").parquet(*[f"{hits}/block={b}" for b in range(blocks.number)])
    whole = parts.groupBy("number").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    whole = whole.select(F.col("number").alias(n + "row"), _merged(F.col("runs")).alias(r), F.col("items").alias(i))
    counted = map_texts(numbered, text, f"{n} bigint", lambda: lambda texts: [[len(fold(t).split()) for t in texts]])
    return counted.join(whole, n + "row", "left").drop(n + "row")
