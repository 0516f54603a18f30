"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code of
length 23. The indices of a segment are the codewords within four bits of it: one, or six where the nearest
codeword is three bits away. Two segments that differ in at most two bits have an index in common.

Two fingerprints that differ in at most four bits agree in one of these ways (pigeonhole): some segment is equal,
and one of the other two, which share four errors, differs in at most two bits; or every segment differs, so none
in more than two bits. Hence the keys: a segment's value with an index of another segment, and triples of
indices. Keys have 33 bits and more, so few fingerprints meet by chance. Fingerprints that meet are verified.

Copies share a fingerprint and are one row from the start. Near copies are many rows of one key; in a run of equal
keys a breadth-first search over the not yet reached rows gives the links of a spanning forest, so a crowd costs
about as many comparisons as it has rows. A run above a bound is set aside and compared block against block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import let_go, map_texts
from signalbox.llm.components import connected_components
from signalbox.session import work_dir

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of one key that one task compares; a longer run is compared in blocks of half as many.
MAX_RUN = 65_536
#: Copies of one text that one task may join, unless more than MAX_HOT texts have more.
HOT_ROWS, MAX_HOT = 2_000, 100_000
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; zero for a text without words."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = words[at : at + SHINGLES + shingle - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Adds ``bits``, the fingerprint as a signed 64-bit integer.

    Null and empty texts have zero; a long text is read shingle by shingle; repeated rows are each marked for
    themselves; an input column of this name is replaced, others stay; an empty table stays empty.
    """

    def work() -> Callable[[list[str]], list]:
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()]

    return map_texts(df, text, "bits bigint", work)


def _syndromes() -> tuple[np.ndarray, ...]:
    """Remainders by the generator, for each byte of a 23-bit word."""
    one = []
    for i in range(24):
        x = 1 << i
        for j in range(i, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        one.append(x)
    tables = []
    for byte in range(3):
        t = np.zeros(256, np.int32)
        for b in range(8):
            t[np.arange(256) >> b & 1 == 1] ^= one[8 * byte + b]
        tables.append(t)
    return tuple(tables)


_TABLES = _syndromes()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _TABLES[0][words & 255] ^ _TABLES[1][words >> 8 & 255] ^ _TABLES[2][words >> 16 & 255]


def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For every syndrome the error patterns of at most four bits, and how many there are (one or six)."""
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns, level = [np.zeros(1, np.int64)], [(0, -1)]
    for _ in range(4):
        level = [(p | int(bits[i]), i) for p, last in level for i in range(last + 1, 23)]
        patterns.append(np.array([p for p, _ in level], np.int64))
    every = np.concatenate(patterns)
    of = syndrome(every)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=2048)
    table = np.zeros((2048, 6), np.int64)
    place = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[of[order], place] = every[order]
    return table, counts


_PATTERNS, _COUNTS = _errors()


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each 23-bit word (n x 6), and which of them are in use."""
    s = syndrome(words)
    return (words[:, None] ^ _PATTERNS[s]) >> 11, np.arange(6) < _COUNTS[s][:, None]


def keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of the fingerprints (unsigned)."""
    parts = [(bits >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near = [indices(p) for p in parts]
    out, rows, row = [], [], np.arange(len(bits))
    for i in range(3):
        for j in range(3):
            if i != j:
                index, used = near[j]
                key = np.int64(3 * i + j) << np.int64(58) | parts[i][:, None] << 12 | index
                out.append(key[used])
                rows.append(np.broadcast_to(row[:, None], used.shape)[used])
    (a, ua), (b, ub), (c, uc) = near
    used = ua[:, :, None, None] & ub[:, None, :, None] & uc[:, None, None, :]
    key = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    out.append((key | np.int64(9) << np.int64(58))[used])
    rows.append(np.broadcast_to(row[:, None, None, None], used.shape)[used])
    return np.concatenate(out), np.concatenate(rows)


def forest(found: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over distinct fingerprints (unsigned) at most ``bound`` bits apart."""
    left, links = found, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bound
            if near.any():
                reached, left = left[near], left[~near]
                links += [(at, x) for x in reached]
                queue += list(reached)
    return links


def _links(batches: Iterator[tuple[np.ndarray, np.ndarray]], bound: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows sorted by key to (key or 0, a, b): links, and the rows of runs above ``most`` with a = b."""
    held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    set_aside = None  # the key whose long run is being passed on

    def settle(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(key):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = np.bitwise_count(bits[two] ^ bits[two + 1]) <= bound
        a, b = bits[two][near], bits[two + 1][near]
        more, long = [], []
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n > most:
                long.append(np.arange(s, s + n))
            else:
                more += forest(bits[s : s + n], bound)
        if more:
            pairs = np.array(more, np.uint64)
            a, b = np.r_[a, pairs[:, 0]], np.r_[b, pairs[:, 1]]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        rows = np.concatenate(long) if long else np.empty(0, np.int64)
        return np.r_[np.zeros(len(pairs), np.int64), key[rows]], np.r_[pairs[:, 0], bits[rows]], np.r_[pairs[:, 1], bits[rows]]

    for key, bits in batches:
        if set_aside is not None:
            end = int(np.searchsorted(key, set_aside, side="right"))
            yield key[:end], bits[:end], bits[:end]
            key, bits = key[end:], bits[end:]
            if not len(key):
                continue
            set_aside = None
        key, bits = np.r_[held_key, key], np.r_[held, bits]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))
        if len(key) - last > most:
            set_aside = key[-1]
            yield settle(key[:last], bits[:last])
            yield key[last:], bits[last:], bits[last:]
            held_key, held = key[:0], bits[:0]
            continue
        if last > 1 << 16 or not len(held_key):
            yield settle(key[:last], bits[:last])
            key, bits = key[last:], bits[last:]
        held_key, held = key, bits
    yield settle(held_key, held)


def find_links(distinct: DataFrame, max_bits: int = MAX_BITS, max_run: int = MAX_RUN) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column ``bits``) at most ``max_bits`` apart.

    Not every pair is a row, but two fingerprints within the distance are always joined by a path.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find fingerprints up to four bits apart")
    spark = distinct.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                bits = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False).view(np.uint64)
                key, row = keys(bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits[row].view(np.int64))], names=["key", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rows = ((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches)
        for key, a, b in _links(rows, max_bits, max_run):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["key", "a", "b"])

    found = work_dir(spark, "simhash-links")
    keyed = distinct.select("bits").mapInArrow(spread, "key bigint, bits bigint")
    keyed.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(meet, "key bigint, a bigint, b bigint").write.parquet(found)
    near = spark.read.parquet(found)
    links = near.filter("key = 0").select("a", "b")
    crowded = near.filter("key <> 0").select("key", F.col("a").alias("bits"))
    if not crowded.limit(1).count():
        return links
    # Long runs: a row goes to every pair of blocks that its own block is part of.
    blocks = crowded.groupBy("key").agg(F.ceil(F.count("*") / (max_run / 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("bits", F.lit(1)), F.col("blocks")).cast("int")
    paired = (
        crowded.join(blocks, "key").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits")
        .select(F.xxhash64("key", "low", "high").alias("key"), "bits")
    )

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rows = ((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches)
        for _, a, b in _links(rows, max_bits, 1 << 62):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rest = paired.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(meet_blocks, "a bigint, b bigint")
    return links.unionAll(rest)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``df``: key, bits, fingerprint (16 hex digits), component_id and component.

    component_id is the smallest key reachable over links of at most ``max_bits`` differing bits; rows with equal
    fingerprints are linked. component is the smallest fingerprint of the component. Null and empty texts have
    fingerprint zero and are linked like others. Null keys don't count as smallest: component_id is null only if
    the component has no other key. Repeated rows stay; an empty table gives no rows; other columns play no part.
    """
    spark = df.sparkSession
    # The only pass over the texts; its narrow result is read several times, so it is written.
    marked = work_dir(spark, "simhash-bits")
    fingerprints(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("given")), "given", shingle).select("key", "bits").write.parquet(marked)
    rows = spark.read.parquet(marked)
    distinct = rows.groupBy("bits").agg(F.min("key").alias("least"))
    roots = connected_components(find_links(distinct, max_bits)).select(F.col("node").alias("bits"), F.col("root").alias("component"))
    rooted = distinct.join(roots, "bits")
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = rooted.join(least, "component").select("bits", "component", "component_id")
    # Fingerprints without a link are their own component.
    members = distinct.join(linked, "bits", "left").select(
        "bits", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component", "bits").alias("component"),
    )
    # A text that fills more than its share of the rows is sent to them; only the others are moved to their fingerprint.
    share = max(HOT_ROWS, rows.count() // MAX_HOT)
    hot = rows.groupBy("bits").count().filter(F.col("count") > share).select("bits")
    if hot.limit(1).count():
        sent = F.broadcast(members.join(F.broadcast(hot), "bits", "left_semi"))  # at most MAX_HOT rows
        placed = rows.join(sent, "bits").unionByName(rows.join(F.broadcast(hot), "bits", "left_anti").join(members, "bits"))
    else:
        placed = rows.join(members, "bits")
    return placed.select(
        F.col("key").alias(key), "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "component"
    )


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The input's columns, one row for each component of near-duplicates: the one with the smallest key.

    Where that key has several rows in the component, the first in the order of the text and the other columns
    stays; a key with different texts may stay for several components, or for one of those that it is in. Of a
    component without any key one row stays, chosen alike.
    """
    spark = df.sparkSession
    found = work_dir(spark, "simhash-components")
    near_duplicates(df, text, key, shingle, max_bits).select(F.col(key).alias("key"), "bits", "component_id", "component").write.parquet(found)
    rows = spark.read.parquet(found)
    # The input's columns travel in one struct, so that no helper meets a column of its name.
    given = df.select(F.col(f"`{key}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    order = F.struct(F.col("text"), F.to_json("row"))
    # Keys that are the smallest of some component. A key's only row is then the component's.
    keys = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("component_id") == F.col("key")).alias("least"))
    keys = keys.filter("least").select("key", "n")
    out = given.join(keys.filter("n = 1"), "key", "left_semi").select("row.*")
    if keys.filter("n > 1").limit(1).count():
        # Of a key with several rows, those in a component whose smallest key it is; their fingerprints tell.
        several = given.join(keys.filter("n > 1"), "key", "left_semi")
        wanted = rows.filter("key = component_id").select("key", "bits", "component").distinct()
        chosen = fingerprints(several, "text", shingle).join(wanted, ["key", "bits"]).groupBy("component").agg(F.min_by("row", order).alias("row"))
        out = out.unionByName(chosen.select("row.*"))
    if rows.filter("key is null").limit(1).count():
        alone = rows.filter("key is null and component_id is null").select("bits", "component").distinct()
        without = given.filter("key is null")
        chosen = fingerprints(without, "text", shingle).join(alone, "bits").groupBy("component").agg(F.min_by("row", order).alias("row"))
        out = out.unionByName(chosen.select("row.*"))
    return out
