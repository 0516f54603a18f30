"""What a Python worker keeps between tasks is gone when another operator runs, and is held once."""

import contextlib
import weakref

import numpy as np
import public_tokenizers
import pytest

from signalbox.llm import byte_bpe, chat_repair, common, huffman, quality_model, secret_scan, simhash
from signalbox.llm.queries import ENCODE_VOCABULARY, FILE_VOCABULARY, vocabulary

DATA = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture
def tasks(spark, monkeypatch):
    """The functions that an operator gives to mapInArrow, run here on no rows; the plan goes on as it would."""
    made, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, schema: (made.append(run), plain(df, run, schema))[1])
    yield made
    common.let_go()


def test_other_work_lets_go_of_the_words(spark, tasks):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(5)
    path = vocabulary(ENCODE_VOCABULARY)
    byte_bpe.encode_and_decode(docs, path, PATTERN)
    encode = tasks.pop()
    flat = quality_model.Model(np.zeros(1 << quality_model.BUCKET_BITS, np.float32), 0.0)
    others = {
        "classify": lambda: quality_model.classify(docs, flat),
        "fit": lambda: quality_model.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")),
        "links": lambda: simhash.find_links(docs.selectExpr("xxhash64(text) bits")),
        "redact": lambda: secret_scan.redact(docs, length="n_chars"),
        "files": lambda: huffman.encode(docs, vocabulary(FILE_VOCABULARY), None),
        "repair": lambda: chat_repair.repair(chat_repair.damage(spark.read.parquet(f"{DATA}/conversations.parquet")), present="present").summary().collect(),
    }
    for name, plan in others.items():
        tasks.clear()
        plan()
        assert tasks, name
        for task in list(tasks):
            held = weakref.ref(byte_bpe.codec(path, PATTERN))
            list(encode(iter([])))
            assert held() is byte_bpe.codec(path, PATTERN)  # its own next task finds it
            with contextlib.suppress(AttributeError):  # a task that asks for its partition has none here
                next(task(iter([])), None)
            assert held() is None, name


def test_a_word_is_kept_once():
    coder = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), PATTERN)
    texts = ["", "plain words plain", " zqxj1, zqxj (zqxj) words, wörd\tzqxj", "zqxj " * 3, "  two  spaces ", "a zqxjk zqxjk", "b zqxjk, it's zqxjk's"]
    got = [coder.encode([t])[0] for t in texts]
    for known in ("plain", "words", "zqxjk"):
        assert known in coder.later
    assert " plain" not in coder.words and " zqxjk" in coder.words and coder.words[" zqxjk"] == coder.later["zqxjk"]
    fresh = [byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), PATTERN).encode([t])[0] for t in texts]
    assert got == fresh and coder.decode(got) == [t.encode() for t in texts]


def test_decoding_goes_in_bounded_parts(monkeypatch):
    coder = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), PATTERN)
    texts = ["", "one two three", "", "wörd " * 40, "x", "many more words than fit " * 9, ""]
    encoded, parts, plain = coder.encode(texts), [], coder._decode
    monkeypatch.setattr(byte_bpe, "DECODE_TOKENS", 20)
    monkeypatch.setattr(coder, "_decode", lambda part: (parts.append(part), plain(part))[1])
    assert coder.decode(encoded) == [t.encode() for t in texts] and coder.decode([]) == []
    assert len(parts) > 3 and all(sum(map(len, p)) <= 80 or sum(map(bool, p)) == 1 for p in parts)
