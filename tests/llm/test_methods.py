"""Methods of the text operators against plain versions, whatever the size of the pieces they work in."""

import random

import numpy as np
import pytest
import tiktoken

from signalbox.llm import byte_bpe, quality_model, quality_rules, secret_scan
from signalbox.llm.queries import ENCODE_VOCABULARY, op4_rules, vocabulary

DATA = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a", "one two  two\tthree\n", "Größe naïve 日本語 \U0001f600 é", "x" * 3000 + " tail", " ".join(f"wörd{i}" for i in range(900)), "\n \n", "same same same"]


def plain_features(text):
    """How many n-grams, words and pairs there are, and every n-gram as a text."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [m[i : i + n] for w in words for m in [["<b>", *w, "<e>"]] for n in (3, 4, 5) for i in range(len(m) - n + 1)]
    return len(grams) + len(words) + max(0, len(words) - 1) + sum(a == b for a, b in zip(words, words[1:])), {tuple(g) for g in grams}


@pytest.mark.parametrize("piece", (1, 7, 100, 1 << 19))
def test_features_don_t_depend_on_pieces(piece, monkeypatch):
    whole = [np.sort(np.concatenate([np.empty(0, np.int32), *quality_model.all_features(t)])) for t in TEXTS]
    monkeypatch.setattr(quality_model, "PIECE", piece)
    for t, want in zip(TEXTS, whole):
        assert (np.sort(np.concatenate([np.empty(0, np.int32), *quality_model.all_features(t)])) == want).all()
        assert "".join(quality_model.pieces(t)) == t


def test_features_are_character_n_grams_of_marked_words():
    for t in TEXTS:
        many, _ = plain_features(t)
        assert sum(len(f) for f in quality_model.all_features(t)) == many
    # One letter outside ASCII is one character, and no n-gram reaches over a word's end.
    grams = lambda t: set(np.concatenate(list(quality_model.all_features(t))).tolist())
    assert len(plain_features("ñandú")[1]) == 5 + 4 + 3 and plain_features("ab cd")[1] == plain_features("cd ab")[1]
    pair = lambda a, b: grams(f"{a} {b}") - grams(a) - grams(b)
    assert len(pair("alpha", "beta")) == 1  # the pair itself, nothing else


def test_one_gradient_step_equals_a_plain_one(monkeypatch):
    """A single minibatch of two bags, computed term by term."""
    monkeypatch.setattr(quality_model, "EPOCHS", 1)
    monkeypatch.setattr(quality_model, "MIN_STEPS", 1)
    bags = [(np.array([3, 9], np.int32), np.array([0.25, 0.75], np.float32)), (np.array([9], np.int32), np.array([1.0], np.float32))]
    table, bias = quality_model.train(bags, np.array([0, 1]), np.array([1.0, 2.0], np.float32))
    start = np.random.default_rng(quality_model.SEED).uniform(-1, 1, (1 << quality_model.BUCKET_BITS, quality_model.DIMENSIONS)).astype(np.float32) / quality_model.DIMENSIONS
    vectors, layer, out = start.copy(), np.zeros((quality_model.DIMENSIONS, 2)), np.zeros(2)
    for (buckets, shares), label, weight in zip(bags, (0, 1), (1.0, 2.0)):
        mean = sum(s * start[b] for b, s in zip(buckets, shares))
        error = np.array([0.5, 0.5]) - np.eye(2)[label]  # the layer is zero, so both classes are as likely
        error *= weight / 2
        layer -= quality_model.RATE * np.outer(mean, error)
        out -= quality_model.RATE * 0.1 * error
    assert np.allclose(table, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-4) and bias == pytest.approx(out[1] - out[0], rel=1e-5)


def plain_verdict(text):
    """reason, number of chunks and of bad ones, by the rule as it is written."""
    import zstandard

    raw = text.encode()
    if not raw:
        return "empty", 0, 0
    ratio = lambda part: len(zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False).compress(part)) / len(part)
    n = quality_rules.CHUNK_BYTES
    chunks = [raw[i : i + n] for i in range(0, len(raw), n)]
    if len(raw) < n:
        chunks = []
    elif len(chunks[-1]) < n:
        chunks[-1] = raw[-n:]
    bad = sum(not quality_rules.CHUNK_BAND[0] <= ratio(c) <= quality_rules.CHUNK_BAND[1] for c in chunks)
    low, high = [(lo, hi) for least, lo, hi in quality_rules.BANDS if len(raw) >= least][-1]
    if ratio(raw) < low:
        return "repetitive", len(chunks), bad
    if ratio(raw) > high:
        return "incompressible", len(chunks), bad
    return ("chunks" if chunks and bad > len(chunks) / 2 else None), len(chunks), bad


def test_verdicts_of_quality_rules(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op4_rules(spark, DATA).collect():
        assert (r["reason"], r["n_chunks"], r["n_bad_chunks"]) == plain_verdict(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["reason"] is None)
    edges = ["a " * 60, "ab" * 1024, "ab" * 1025, "é" * 1024, "".join(chr(33 + i * 7919 % 600) for i in range(5000)), "x"]
    df = spark.createDataFrame(list(enumerate(edges)), "doc_id int, text string")
    got = {r["doc_id"]: (r["reason"], r["n_chunks"], r["n_bad_chunks"]) for r in quality_rules.apply_rules(df).collect()}
    assert got == {i: plain_verdict(t) for i, t in enumerate(edges)} and got[0][0] == "repetitive" and got[1][1] == 1 and got[2][1] == 2


def test_long_words_equal_the_library():
    import base64

    import public_tokenizers

    path = vocabulary(ENCODE_VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    rnd = random.Random(6)
    words = []
    for size in (255, 256, 257, 300):
        words += ["a" * size, "ab" * (size // 2) + "a" * (size % 2), "".join(rnd.choice("abcdefgh") for _ in range(size)), "".join(rnd.choice("éaüñ") for _ in range(size // 2)), "the" * (size // 3)]
    for word, ids in zip(words, codec.encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word)


def test_secrets_after_schemes_and_in_other_scripts():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N"
    for text in (f"Authorization: Bearer {jwt}", f"authorization = 'basic {jwt}'", f"curl -H 'Bearer {jwt}'", f"token: {jwt}", f"auth is Token {jwt}."):
        spans = [(text[a:b], k) for a, b, k, _ in secret_scan.find_in(text) if k == 3] or [(text[a:b], k) for a, b, k, _ in secret_scan.find_in(text)]
        assert any(jwt in value for value, _ in spans), text
    for value in ("пароль9Xq2Zw", "ключ-7f3Kd9Ð", "日本8Gx2Lq7"):
        text = f"password: {value} end"
        assert [text[a:b] for a, b, k, _ in secret_scan.find_in(text) if k == 3] == [value]


CLEAN = [
    'passphrase = os.environ.get("KEY")', "auth = parser.next_token()", "credentials: http://example.com/docs/index.html", "pwd=/usr/local/share/docs",
    "private_key: ./config/keys/readme.md", "access_key = settings.access_key", "passcode := user.getInput(form)", "auth: https://docs.example.org:8080/auth/login",
    "the bearer of this letter is welcome here", "Basic understanding of networks", "credentials = load_credentials(path)", "pwd is $HOME/projects", "auth => request->headers",
]


def test_clean_code_has_no_secrets():
    found = {t: [t[a:b] for a, b, _, _ in secret_scan.find_in(t)] for t in CLEAN}
    assert {t: f for t, f in found.items() if f} == {}


def test_random_values_are_no_code():
    rnd = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["".join(rnd.choice(alphabet) for _ in range(24)) for _ in range(200)]
    values += [".".join("".join(rnd.choice(alphabet) for _ in range(16)) for _ in range(3)) for _ in range(200)]
    values += ["/".join("".join(rnd.choice(alphabet) for _ in range(12)) for _ in range(2)) for _ in range(200)]
    assert sum(map(secret_scan.is_code, values)) == 0
    for value in values[:100]:
        assert any(k == 3 for _, _, k, _ in secret_scan.find_in(f"pwd: {value}"))
