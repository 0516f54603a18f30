"""Token ids in files: canonical length-limited Huffman codes by the ids' global counts.

Texts are encoded once; the ids are counted over all of them, and the counts, one for each id of the vocabulary, give
code lengths by package-merge. Code lengths alone describe a canonical code. Documents are sorted by key over all
partitions, and each partition becomes a sequence of blocks of whole documents. A block can be read without
any other: it holds the keys and sizes of its documents, the coded ids, and the bit offset of every CHECKPOINT-th id.
Checkpoints are places to begin at, so a reader decodes from all of them at once, one table lookup an id for each.

A folder of files has three parts, all written by Spark, on any storage: ``codes`` (id, bits), ``blocks`` (file,
block, first, n, keys, sizes, checkpoints, bits) and ``files`` (file, first): where the ids of a file begin in the
whole sequence. ``first`` of a block counts from the beginning of its file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.llm.common import keep, let_go, slices
from signalbox.llm.token_counts import balanced

#: Ids in a block, but for a longer document, which is a block of its own; ids from one checkpoint to the next.
BLOCK, CHECKPOINT = 1 << 19, 256
#: The longest code, unless the vocabulary needs more; a reader's table has 2 to this power entries.
LONGEST = 18
#: Ids that are coded or decoded at a time, a multiple of CHECKPOINT.
CHUNK = 1 << 19
#: Bytes that the words and ids that a task remembers may take, about; beyond it forgets them all and goes on.
MEMORY_BYTES, ENTRY_BYTES = 256 << 20, 160
#: Bytes of unseen words that go to the library as one text.
PIECES_BYTES = 4 << 10

# Fixed value: a pre-tokenizer pattern that never matches white space, for which words can be encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose small letters and canonical composition are the same in every version of Unicode, then ASCII marks;
#: no apostrophe, which may begin a match of WORD_PATTERN that goes on with letters.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]*)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"


# ---- text to ids -----------------------------------------------------------------------------


class Encoder:
    """Texts to ids by a tokenizer file; ids are little-endian unsigned integers of ``type``.

    Where the vocabulary drops white space, a text is the sequence of its words between ASCII white space. Most words
    are letters and then marks: the letters, made small, and the marks are encoded by themselves. What was seen before
    needs no second encoding; unseen letters go to the library as one text, in which the tokens that end a word show
    where each of them ends. All else goes to the library word by word, or whole where white space counts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values())
        self.type = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.by_word, self.suffix = by_word(path)
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if self.suffix and token.endswith(self.suffix)]] = True
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({"": b""}, {"": b""})  # whole words; parts of words
        self.held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(made.ids, self.type).tobytes() for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of letters alone or marks alone, each of which is one match of WORD_PATTERN."""
        flat = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, self.type)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(parts):
            return self._encode(parts)
        data, at = flat.tobytes(), [0, *(self.type.itemsize * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, words: list[str], parts: bool) -> list[bytes]:
        """The ids of distinct words, or parts of words."""
        known = self.known[parts]
        new = [w for w in words if w not in known]
        if new and self.held > MEMORY_BYTES:
            for every in self.known:
                every.clear()
                every[""] = b""
            self.held, new = 0, [w for w in words if w]
        for batch in balanced(iter(new), PIECES_BYTES):
            made = self._encode_parts(batch) if parts else self._encode(batch)
            known.update(zip(batch, made, strict=True))
            self.held += sum(map(len, batch)) + sum(map(len, made)) + ENTRY_BYTES * len(batch)
        return list(map(known.__getitem__, words))

    def _split(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of what distinct words are made of, and for every word the numbers of its two parts."""
        none = pa.array([""], pa.string())
        if self.suffix:
            found = pc.extract_regex(words, PLAIN)
            plain = pc.is_valid(found)
            core = pc.utf8_lower(pc.fill_null(pc.struct_field(found, "core"), "")).dictionary_encode()
            tail = pc.fill_null(pc.struct_field(found, "tail"), "").dictionary_encode()
        else:
            plain = pa.array(np.zeros(len(words), bool))
            core = tail = none.take(pa.array(np.zeros(len(words), np.int64))).dictionary_encode()
        odd = words.filter(pc.invert(plain)).to_pylist()
        core_made, tail_made = (self._ids(d.dictionary.to_pylist(), True) for d in (core, tail))
        made = [*core_made, *tail_made, *self._ids(odd, False), b""]
        first, second = core.indices.to_numpy().astype(np.int64), len(core_made) + tail.indices.to_numpy()
        place = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        first[place], second[place] = len(core_made) + len(tail_made) + np.arange(len(odd)), len(made) - 1
        return made, np.stack([first, second], 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text ends in it; null is the empty text."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            made = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(made), self.type), np.cumsum([len(m) // self.type.itemsize for m in made])
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        made, parts = self._split(coded.dictionary)
        data, sizes = np.frombuffer(b"".join(made), self.type), np.array([len(m) // self.type.itemsize for m in made], np.int64)
        data, ends = _gathered(data, np.cumsum(sizes), sizes, parts.reshape(-1))
        ends = ends[1::2]  # of the distinct words
        out, ends = _gathered(data, ends, np.diff(ends, prepend=0), coded.indices.to_numpy())
        return out, np.r_[0, ends][np.cumsum(pc.list_value_length(lists).to_numpy())]


def _gathered(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``data`` (given by ends and sizes) in the order of ``index``, joined, and where each ends."""
    many = sizes[index]
    out = np.cumsum(many)
    total = int(out[-1]) if len(out) else 0
    return data[np.repeat(ends[index] - out, many) + np.arange(total)], out


def encoder(path: str) -> Encoder:
    """A Python worker that runs several tasks remembers their words."""
    return keep(("huffman", path), lambda: Encoder(path))


def by_word(path: str) -> tuple[bool, str]:
    """Whether white space only separates: a split by WORD_PATTERN, no white space in added tokens, and a normalizer
    that changes a letter whatever stands beyond white space. Then also the suffix of tokens that end a word, if
    small letters are all that the normalizer makes of PLAIN words, else nothing."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, normal = model.get("pre_tokenizer") or {}, model.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    splits = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("invert") and first.get("behavior") == "Removed"
    steps = normal.get("normalizers") or ([normal] if normal else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    tokens = model.get("added_tokens") or []
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\r\x0b\x0c")) for t in tokens)
    small = any(s["type"] == "Lowercase" for s in steps) and all(t["content"].startswith("<|") for t in tokens)
    if not (splits and plain and added):
        return False, ""
    return True, (model["model"].get("end_of_word_suffix") or "") if small else ""


def encode(df: DataFrame, path: str, end_id: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ``ids``: the ids of a text as little-endian integers, two bytes each if the vocabulary allows, else four."""
    from pyspark.sql.pandas.types import to_arrow_schema

    given = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([given.schema["key"], T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(("huffman", path))
        words = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, ends = words(part.column(1))
                if end_id is not None:
                    flat, ends = np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)
                data, at = flat.astype(words.type).tobytes(), (words.type.itemsize * np.r_[0, ends]).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary()).cast(arrow.field("ids").type)], schema=arrow)

    return given.mapInArrow(run, schema)


# ---- codes -----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (or as few more as the symbols need) for positive counts."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    merged, kinds = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")  # leaves stand before packages of the same weight
        merged = both[place]
        kinds.append(place < n)
    sizes, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        k = int(leaf[:take].sum())
        sizes[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = sizes
    return out


def canonical(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes of symbols with these lengths: by length and then by id, counting upwards."""
    codes, code, last = np.zeros(len(ids), np.uint64), 0, 0
    for i in np.lexsort((ids, sizes)).tolist():
        size = int(sizes[i])
        code <<= size - last
        codes[i], code, last = code, code + 1, size
    return codes


class Coder:
    """Codes and decodes sequences of ids by a table of (id, bits)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        top = int(ids.max(initial=-1)) + 1
        self.sizes, self.codes = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        codes = canonical(ids, sizes)
        self.sizes[ids], self.codes[ids] = sizes, codes
        self.longest = int(sizes.max(initial=1))
        # Every window of ``longest`` bits that begins with a code holds its id and length.
        self.table = np.zeros(1 << self.longest, np.int64)
        for i in np.argsort(codes << (self.longest - sizes).astype(np.uint64)).tolist():
            spare = self.longest - int(sizes[i])
            begin = int(codes[i]) << spare
            self.table[begin : begin + (1 << spare)] = int(ids[i]) << 6 | int(sizes[i])

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the checkpoints, and the bits. Every CHUNK of ids begins a new 32-bit word."""
        checks, out, words = [], [], 0
        for at in range(0, len(ids), CHUNK):
            part = ids[at : at + CHUNK]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            checks.append(starts[::CHECKPOINT] + 32 * words)
            bits = self.codes[part] << (64 - (starts & 31) - sizes).astype(np.uint64)
            word, n = starts >> 5, int(ends[-1] + 31 >> 5)
            # Bits of different ids never overlap, so adding them up is exact and the same as joining them.
            packed = np.bincount(word, (bits >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(word + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[: n + 1]
            out.append(packed[:n].astype(">u4").tobytes())
            words += n
        return (np.concatenate(checks) if checks else np.empty(0, np.int64)), b"".join(out)

    def unpack(self, checkpoints: np.ndarray, bits: bytes, n: int) -> np.ndarray:
        """The ids of a block, decoded from all its checkpoints at once, CHUNK ids at a time."""
        out, lanes = np.empty(n, np.int32), CHUNK // CHECKPOINT
        past = CHECKPOINT * self.longest // 8 + 8  # how far a lane may run on behind its last id
        for at in range(0, n, CHUNK):
            ends = min(n, at + CHUNK)
            first = at // CHECKPOINT
            place = checkpoints[first : first + lanes]
            base = int(place[0]) >> 3
            stop = int(checkpoints[first + lanes]) >> 3 if first + lanes < len(checkpoints) else len(bits)
            raw = np.frombuffer(bits[base:stop] + bytes(past), np.uint8).astype(np.uint32)
            window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
            place = place - 8 * base
            made = np.empty((CHECKPOINT, len(place)), np.int32)
            shift, mask = 32 - self.longest, (1 << self.longest) - 1
            for i in range(CHECKPOINT):
                entry = self.table[window[place >> 3] >> (shift - (place & 7)) & mask]
                made[i] = entry >> 6
                place += entry & 63
            out[at:ends] = made.T.reshape(-1)[: ends - at]
        return out


# ---- files -----------------------------------------------------------------------------------

_BLOCK = "file int, block int, first bigint, n bigint, sizes array<bigint>, checkpoints array<bigint>, bits binary"


def write_ids(df: DataFrame, path: str, folder: str, text: str = "text", key: str = "doc_id", end_id: int | None = 2) -> str:
    """Writes the token ids of every text to a new ``folder``, in the order of ``key``; returns the folder.

    ``path`` is a file of the tokenizers library; special strings inside texts are taken as it takes them by default,
    none are added, and ``end_id`` follows every text. Null and empty texts have the end alone. Null keys come
    first, rows of one key stand in the order of a hash of their ids, and every repeated row is written. An empty table
    gives a folder without blocks. Other columns, whatever their names, play no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    encode(df, path, end_id, text, key).write.parquet(f"{folder}/ids")  # texts are encoded once; what follows reads ids
    encoded = spark.read.parquet(f"{folder}/ids")
    width = encoder(path).type

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            part = np.bincount(np.frombuffer(b"".join(column.to_pylist()), width))
            if len(part) > len(total):
                total, part = part, total
            total[: len(part)] += part
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    # One row for each id of the vocabulary, whatever the size of the input.
    counts = encoded.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids, sizes = np.array([r["id"] for r in counts], np.int64), code_lengths(np.array([r["n"] for r in counts], np.int64))
    codes = spark.createDataFrame(list(zip(ids.tolist(), sizes.tolist())), "id int, bits int")
    codes.coalesce(1).write.parquet(f"{folder}/codes")

    schema = T.StructType([*T._parse_datatype_string(_BLOCK).fields, T.StructField("keys", T.ArrayType(df.schema[key].dataType))])
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = Coder(ids, sizes), TaskContext.get().partitionId()
        keys, data, held, block, first = [], [], 0, 0, 0

        def made() -> pa.RecordBatch:
            joined = np.frombuffer(b"".join(data), width)
            checks, bits = coder.pack(joined)
            values = [file, block, first, len(joined), [len(d) // width.itemsize for d in data], checks, bits, keys]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.column(1)[at].as_py()
                size = len(one) // width.itemsize
                if held and held + size > BLOCK:
                    yield made()
                    keys, data, held, block, first = [], [], 0, block + 1, first + held
                keys.append(batch.column(0)[at].as_py())
                data.append(one)
                held += size
        if keys:
            yield made()

    order = [F.col("key").asc_nulls_first(), F.xxhash64("ids"), F.col("place")]
    # The place tells apart what is equal, so that copies of one row can lie in several partitions.
    sorted_ids = encoded.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ids.select("key", "ids").mapInArrow(blocks, schema).write.parquet(f"{folder}/blocks")
    held = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect()
    firsts = [0, *accumulate(r["n"] for r in held)]
    spark.createDataFrame([(r["file"], f) for r, f in zip(held, firsts)], "file int, first bigint").coalesce(1).write.parquet(f"{folder}/files")
    return folder


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of a folder of ``write_ids``: key, start (ids before it), n_tokens, ids_crc32 and, if
    ``with_ids``, ids (array<int>). Blocks are read independently, without a shuffle.

    The digest is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    codes = spark.read.parquet(f"{folder}/codes").collect()  # of the vocabulary
    ids, sizes = np.array([r["id"] for r in codes], np.int64), np.array([r["bits"] for r in codes], np.int64)
    firsts = {r["file"]: r["first"] for r in spark.read.parquet(f"{folder}/files").collect()}  # one for each file
    blocks = spark.read.parquet(f"{folder}/blocks").select("file", "first", "n", "sizes", "checkpoints", "bits", "keys")
    fields = [T.StructField(key, blocks.schema["keys"].dataType.elementType), *T._parse_datatype_string("start bigint, n_tokens bigint, ids_crc32 bigint").fields]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, sizes)
        for batch in batches:
            for at in range(batch.num_rows):
                file, first, n = (batch.column(i)[at].as_py() for i in range(3))
                counts = batch.column(3)[at].values.to_numpy()
                out = coder.unpack(batch.column(4)[at].values.to_numpy(), batch.column(5)[at].as_py(), n)
                ends = np.cumsum(counts)
                data = memoryview(out.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(data[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), counts.tolist())]
                columns = [batch.column(6)[at].values, pa.array(firsts[file] + first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), out))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return blocks.mapInArrow(read, schema)
