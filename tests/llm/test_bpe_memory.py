"""What a worker remembers of words: kept between tasks, and forgotten a part at a time."""

import struct

import public_tokenizers

from signalbox.llm import byte_bpe
from signalbox.llm.queries import ENCODE_VOCABULARY, vocabulary


def test_words_in_use_stay_known(monkeypatch):
    path = vocabulary(ENCODE_VOCABULARY)
    monkeypatch.setattr(byte_bpe, "MEMORY", 60)
    learnt, coder = [], byte_bpe.Codec(path, public_tokenizers.PATTERN)
    contract = coder._contract
    monkeypatch.setattr(coder, "_contract", lambda words, raw, long=False: (learnt.extend(words), contract(words, raw, long)))
    word = lambda n: "zq" + "".join(chr(97 + int(d)) for d in f"{n:04}") + "xj"
    often = [word(n) for n in range(10)]
    texts = [" ".join(["", *often, *[word(100 * k + n) for n in range(1, 21)]]) for k in range(1, 12)]
    got = [b for t in texts for b in coder.encode([t])]
    assert all(learnt.count(" " + w) <= 1 for w in often)
    assert max(map(len, (coder.words, coder.first, coder.later))) <= 60
    monkeypatch.undo()
    assert got == byte_bpe.Codec(path, public_tokenizers.PATTERN).encode(texts)
    ids = [i for (i,) in struct.iter_unpack("<I", got[0])]
    assert len(ids) == len(got[0]) // 4 and coder.decode(got) == [t.encode() for t in texts]


def test_a_worker_builds_one_codec():
    path = vocabulary(ENCODE_VOCABULARY)
    assert byte_bpe.codec(path, public_tokenizers.PATTERN) is byte_bpe.codec(path, public_tokenizers.PATTERN)


def test_pieces_are_split_together(monkeypatch):
    coder, calls = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN), []
    match = coder.match
    monkeypatch.setattr(coder, "match", lambda text: calls.append(text) or match(text))
    texts = ["one, two.\nthree four's (five) 6six " + " ".join(f"w{n}x.\nY{n}" for n in range(200)), "a b\n c  d é ", ""]
    got = coder.encode(texts)
    assert len(calls) < 60
    alone = byte_bpe.Codec(vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN)
    monkeypatch.setattr(alone, "_split", lambda pieces: [match(p) for p in pieces])
    assert got == alone.encode(texts) and coder.decode(got) == [t.encode() for t in texts]
    assert coder._split([" a", "b c"]) == [[" a"], ["b", " c"]]


def test_sure_pairs_change_no_ids(monkeypatch):
    import base64
    import random

    import tiktoken

    path = vocabulary(ENCODE_VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(5)
    texts = ["".join(dice.choices("etaoinsrhé ßñ.'#1日я\n" if n % 2 else "aab n", k=dice.randint(1, 60))) for n in range(1500)]
    coder, given = byte_bpe.Codec(path, public_tokenizers.PATTERN), []

    class Db:
        def __init__(self, db):
            self.db = db

        def __getattr__(self, name):
            return getattr(self.db, name)

        def register(self, name, rows):
            given.extend([rows] if name == "bytes" else [])
            return self.db.register(name, rows)

    coder.db = Db(coder.db)
    got = coder.encode(texts)
    assert [[i for (i,) in struct.iter_unpack("<I", b)] for b in got] == [library.encode_ordinary(t) for t in texts]
    begun = sum(rows.column("size").to_numpy().sum() for rows in given)
    assert sum(map(len, given)) < 0.9 * begun  # fewer rows than bytes enter the recursion
