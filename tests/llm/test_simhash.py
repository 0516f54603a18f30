"""Fingerprints, Golay keys, links and components against brute force."""

import numpy as np
import pytest
import xxhash

from signalbox.llm import components, simhash
from signalbox.llm.queries import op5_simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bound=4):
    """rows: (key, unsigned fingerprint); smallest key of each row's component."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bound:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", "One", "a b c", "A b  c\td", "x y z w " * 30, "é É ß\x85a \x1c b c d e f", "a\nb\rc\x0bd\x0ce f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(map(str, range(500)))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


def test_words_two_bits_apart_share_an_index():
    random = np.random.default_rng(1)
    x = random.integers(0, 1 << 23, 3000)
    assert simhash.syndrome(np.array([simhash.GENERATOR]))[0] == 0
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    a, used_a = simhash.indices(x)
    for flip in flips:
        b, used_b = simhash.indices(x ^ flip)
        meet = (a[:, :, None] == b[:, None, :]) & used_a[:, :, None] & used_b[:, None, :]
        assert meet.any((1, 2)).all()


def test_keys_meet_within_four_bits():
    random = np.random.default_rng(2)
    for _ in range(400):
        x = int(random.integers(0, 1 << 63)) * 2 + int(random.integers(0, 2))
        y = x
        for bit in random.choice(64, random.integers(0, 5), replace=False):
            y ^= 1 << int(bit)
        kx, _ = simhash.keys(np.array([x], np.uint64))
        ky, _ = simhash.keys(np.array([y], np.uint64))
        assert set(kx.tolist()) & set(ky.tolist())


def crowd(seed, n):
    """Random fingerprints, clusters round some of them, and chains of small steps."""
    random = np.random.default_rng(seed)
    out = [int(v) for v in random.integers(0, 1 << 63, n)]
    for centre in out[:5]:
        for _ in range(n // 5):
            v = centre
            for bit in random.choice(64, random.integers(1, 6), replace=False):
                v ^= 1 << int(bit)
            out.append(v)
    v = out[7]
    for i in range(0, 60, 4):
        v ^= 0b1111 << i
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("most", [simhash.MAX_RUN, 8])
def test_links_connect_what_brute_force_connects(spark, most):
    values = crowd(3, 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "bits bigint").repartition(3)
    links = simhash.find_links(df, max_run=most)
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    ours = {}
    for s in signed:
        ours.setdefault(got.get(s, s), set()).add(s)
    want = {}
    for s, least in zip(signed, plain_components([(i, v) for i, v in enumerate(values)])):
        want.setdefault(least, set()).add(s)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))
    for a, b in [tuple(r) for r in links.collect()]:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4


def test_long_runs_cross_batches():
    key = np.repeat(np.arange(6), [1, 40, 2, 3, 40, 1])
    bits = np.arange(len(key)).astype(np.uint64)
    for size in (1, 3, 7, 100):
        batches = [(key[i : i + size], bits[i : i + size]) for i in range(0, len(key), size)]
        out = [np.concatenate(c) for c in zip(*simhash._links(iter(batches), 64, 10))]
        aside = out[0] != 0
        assert sorted(out[1][aside].tolist()) == sorted(bits[(key == 1) | (key == 4)].tolist())
        assert (~aside).sum() == 1 + 2  # one link of the pair, two of the three


def test_components_of_stars_chains_and_loops(spark):
    edges = [(1, 2), (2, 1), (2, 3), (5, 5), (9, 8), (8, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(51)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicates_edges(spark):
    rows = [(5, "a b c d e", "u"), (4, "A b c d e", "v"), (4, "A b c d e", "v"), (7, None, "w"), (6, "", "x"), (None, "a b c d e", "y"), (None, "zz yy xx ww", "z"), (None, "zz yy xx ww", "z"), (9, "quite another text here", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bits string")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 4), (0, None), (0, None), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6), (9, 9)], key=str)
    kept = sorted(map(str, (tuple(r) for r in simhash.deduplicate(df).collect())))
    assert kept == sorted(map(str, [(4, "A b c d e", "v"), (6, "", "x"), (9, "quite another text here", "q"), (None, "zz yy xx ww", "z")]))
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.deduplicate(df.limit(0)).collect() == []


def test_repeated_key_with_different_texts(spark):
    one, two, three, four = ("one quite long text here", "zz yy xx ww vv", "something else there is not", "and the fourth has its own words")
    rows = [(1, one, "a"), (2, one, "b"), (2, two, "c"), (5, two, "d"), (3, three, "e"), (3, four, "f"), (3, four, "e"), (6, three, "g"), (7, four, "h"), (8, "the last is alone with it", "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string").repartition(3)
    assert len({r["component"] for r in simhash.near_duplicates(df).collect()}) == 5
    kept = sorted(tuple(r) for r in simhash.deduplicate(df).collect())
    assert kept == sorted([(1, one, "a"), (2, two, "c"), (3, three, "e"), (3, four, "e"), (8, "the last is alone with it", "i")])


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {(k, format(f, "016x"), c) for (k, f), c in zip(rows, plain_components(rows))}
    assert {tuple(r) for r in op5_simhash(spark, data).collect()} == want
