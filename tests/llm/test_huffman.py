"""Token files against the library, and the codes against plain versions."""

import heapq
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.llm import huffman
from signalbox.llm.queries import FILE_VOCABULARY, op11_huffman, vocabulary
from signalbox.session import work_dir

DATA = "/root/testdata/sf0.001"


def library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(FILE_VOCABULARY))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def plain_cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def limited_cost(counts, longest):
    """The least cost under a limit, by trying all sorted lengths."""
    order, best = sorted(counts, reverse=True), None

    def go(i, least, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(order):
            best = cost
            return
        for size in range(least, longest + 1):
            left = room - 2 ** (longest - size)
            if left >= 0:
                go(i + 1, size, left, cost + size * order[i])

    go(0, 1, 2**longest, 0)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_code_lengths_are_optimal(seed):
    random = np.random.default_rng(seed)
    counts = random.integers(1, 1000, 300)
    assert (huffman.code_lengths(counts, 40) * counts).sum() == plain_cost(counts.tolist())
    few = (2 ** random.uniform(0, 14, 8)).astype(np.int64)
    for longest in (3, 4, 5):
        sizes = huffman.code_lengths(few, longest)
        assert sizes.max() <= longest and (sizes * few).sum() == limited_cost(few.tolist(), longest)


def test_codes_are_canonical_and_free_of_prefixes():
    ids, sizes = np.array([9, 4, 7, 2, 5]), np.array([2, 3, 2, 3, 2])
    codes = huffman.canonical(ids, sizes)
    words = {int(i): format(int(c), f"0{s}b") for i, c, s in zip(ids, codes, sizes)}
    assert words == {5: "00", 7: "01", 9: "10", 2: "110", 4: "111"}


@pytest.mark.parametrize("n", (0, 1, 255, 256, 257, 5000))
def test_round_trip_from_any_checkpoint(n, monkeypatch):
    monkeypatch.setattr(huffman, "CHUNK", 4 * huffman.CHECKPOINT)  # several chunks
    data = (np.random.default_rng(n).zipf(1.2, n) % 60_000).astype("<u2")
    ids, counts = np.unique(data, return_counts=True)
    coder = huffman.Coder(ids.astype(np.int64), huffman.code_lengths(counts))
    checks, bits = coder.pack(data)
    assert len(checks) == -(-n // huffman.CHECKPOINT)
    assert (coder.unpack(checks, bits, n) == data).all()
    # A checkpoint is a place to begin at: bit by bit from there on.
    codes = {format(int(coder.codes[i]), f"0{coder.sizes[i]}b"): int(i) for i in ids}
    text = "".join(format(b, "08b") for b in bits)
    for k in range(0, len(checks), 3):
        at, word = int(checks[k]), ""
        for want in data[k * huffman.CHECKPOINT :][:20]:
            while word not in codes:
                word, at = word + text[at], at + 1
            assert codes[word] == want
            word = ""


def want(rows):
    """(doc_id, start, n, crc) of rows that are already in order."""
    out, at = [], 0
    for (doc, _), ids in zip(rows, library([t or "" for _, t in rows])):
        data = np.array([*ids, 2], "<u4")
        out.append((doc, at, len(data), zlib.crc32(data.tobytes())))
        at += len(data)
    return out


def test_query_equals_the_library(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in op11_huffman(spark, DATA).collect()) == want(rows)


ODD = [
    "", None, "it's <|endoftext|>mid<|startoftext|> word", "a\u0085b c d", "é ́x", "İSTANBUL ß ﬁ", "\x1c\x1d x", "don't  \t\nWON'T 12345",
    "x" * 5000, " ".join(f"w{i}" for i in range(3000)), "\U0001f600‍\U0001f600 日本語 テスト", "<|endof text|>", "  ",
]


def test_odd_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 100)
    rows = list(enumerate(ODD))
    given = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id int, text string, ids int, key string")
    folder = huffman.write_ids(given, vocabulary(FILE_VOCABULARY), work_dir(spark, "test-ids"))
    back = huffman.read_ids(spark, folder).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in back] == want(rows)
    assert [r["ids"] for r in back] == [[*ids, 2] for ids in library([t or "" for t in ODD])]
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert sorted(d for r in blocks.collect() for d in r["keys"]) == list(range(len(ODD)))


def test_keys_that_are_null_or_repeated(spark):
    rows = [(None, "a b"), (3, "c"), (3, "c"), (3, "d e f"), (-1, "z"), (None, "a b")]
    folder = huffman.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary(FILE_VOCABULARY), work_dir(spark, "test-ids"))
    back = huffman.read_ids(spark, folder, with_ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, None, -1, 3, 3, 3]
    ends = [r["start"] + r["n_tokens"] for r in back]
    assert [0, *ends[:-1]] == [r["start"] for r in back]
    assert sorted(r["n_tokens"] for r in back) == [2, 2, 2, 3, 3, 4]


def test_empty_table_and_single_symbol(spark):
    schema = "doc_id bigint, text string"
    folder = huffman.write_ids(spark.createDataFrame([], schema), vocabulary(FILE_VOCABULARY), work_dir(spark, "test-ids"))
    assert huffman.read_ids(spark, folder).collect() == []
    folder = huffman.write_ids(spark.createDataFrame([(1, ""), (2, None)], schema), vocabulary(FILE_VOCABULARY), work_dir(spark, "test-ids"))
    assert [r["ids"] for r in huffman.read_ids(spark, folder).orderBy("doc_id").collect()] == [[2], [2]]


def test_one_key_with_most_rows_is_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("the same words").alias("text"))
    folder = huffman.write_ids(df, vocabulary(FILE_VOCABULARY), work_dir(spark, "test-ids"))
    back = huffman.read_ids(spark, folder, with_ids=False)
    n = len(library(["the same words"])[0]) + 1
    assert sorted(r["start"] for r in back.collect()) == list(range(0, 3000 * n, n))
