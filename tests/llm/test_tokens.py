"""Counts and ids against the libraries on whole texts."""

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest

from signalbox.llm import byte_bpe, token_counts
from signalbox.llm.queries import COUNT_VOCABULARY, ENCODE_VOCABULARY, op6_tokens, op7_bpe, vocabulary

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  a  b", "a \n b\n\nc", "x <|endoftext|> y<|endoftext|>", "é à b ​ c", "日本語 テキスト 12 34", "a" * 3000,
    "I'll 've 's don't", "\ttab \r\n", "🙂 🙂🙂 é", "0123456789 " * 50, "A B　C \x85 D", " ᠎ x", "-- -- !! $$$", "aaab" * 300,
]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    for name in (COUNT_VOCABULARY, "word_bpe_49k.json"):
        path = vocabulary(name)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        assert token_counts.Counter(path)(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_counts_by_sentencepiece(texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.Counter(path)(texts) == [len(model.encode(t)) for t in texts]


def test_memory_is_bounded_without_changing_counts(texts, monkeypatch):
    path = vocabulary(COUNT_VOCABULARY)
    want = token_counts.Counter(path)(texts)
    monkeypatch.setattr(token_counts, "MEMORY", 50)
    count = token_counts.Counter(path)
    assert [n for t in texts for n in count([t])] == want


def test_batches_are_balanced():
    pieces = ["ab", "é" * 10, "x" * 100, "y", "z"]
    assert list(token_counts.balanced(iter(pieces), 25)) == [["ab", "é" * 10], ["x" * 100], ["y", "z"]]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(vocabulary(ENCODE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(texts, encoding, monkeypatch):
    codec = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN)
    want = [encoding.encode_ordinary(t) for t in texts]
    got = codec.encode(texts)
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in got] == want
    assert codec.decode(got) == [t.encode() for t in texts]
    monkeypatch.setattr(byte_bpe, "MEMORY", 40)
    small = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN)
    assert [b for t in texts[:40] for b in small.encode([t])] == got[:40]
    assert codec.decode([]) == [] and codec.decode([b""]) == [b""]


def test_queries(spark, encoding):
    from tokenizers import Tokenizer

    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op7_bpe(spark, DATA).collect():
        ids = encoding.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
    tokenizer = Tokenizer.from_file(vocabulary(COUNT_VOCABULARY))
    for r in op6_tokens(spark, DATA).collect():
        n = len(tokenizer.encode(rows[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(rows[r["doc_id"]].encode()), n, n > 512)


def test_a_worker_keeps_its_counter_between_tasks():
    path = vocabulary(COUNT_VOCABULARY)
    assert token_counts.counter(path) is token_counts.counter(path)


def test_known_pieces_are_not_encoded_again(texts, monkeypatch):
    path = vocabulary(COUNT_VOCABULARY)
    count, met = token_counts.Counter(path), []
    encode = count.encode
    monkeypatch.setattr(count, "encode", lambda batch: met.extend(batch) or encode(batch))
    want = count(texts)
    monkeypatch.setattr(token_counts, "MEMORY", 10)  # more is wanted at once than is remembered
    met.clear()
    assert count(texts) == want and met == []


def test_pieces_are_those_between_safe_spaces(texts):
    for some in (texts, ODD, texts[len(ODD):], [], [""], ["x  y"], ["a b c", " ", "é  ü ñ", "", "a b\n c d"]):
        cut, want = token_counts.Pieces(some), [token_counts.SAFE_SPACE.split(t) for t in some]
        assert [cut.words[i] for i in cut.at] == [p for c in want for p in c]
        assert cut.starts.tolist() == [sum(map(len, want[:i])) for i in range(len(want) + 1)]
        assert np.flatnonzero(cut.leads).tolist() == cut.starts[:-1].tolist()


def test_pieces_are_encoded_together_where_their_ends_are_known(texts, monkeypatch):
    path = vocabulary(COUNT_VOCABULARY)
    count, met = token_counts.Counter(path), []
    encode = count.encode
    monkeypatch.setattr(count, "encode", lambda batch: met.extend(batch) or encode(batch))
    want = count(texts)
    assert not any(" " + w in met for t in texts for w in t.split(" ")[1:] if w.isascii() and w.isalpha())
    alone = token_counts.Counter(path)
    monkeypatch.setattr(alone, "encode_joined", lambda batch: None)
    assert alone(texts) == want
