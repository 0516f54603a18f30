"""Byte-level BPE encoding and decoding by recursive SQL, one in-process DuckDB per Python worker.

A word (a match of the split pattern) starts as one row for each byte, keyed by its byte offset. Each step of the
recursion joins neighbouring tokens with the merge table, takes each word's leftmost pair of the smallest rank, and
contracts it; a word without a pair has reached its fixpoint and leaves the recursion. Pairs of bytes that surely merge
have done so before the first step. Decoding joins ids with the vocabulary and aggregates the bytes of some texts in order.

A merge table isn't part of a rank file: two tokens merge where their joined bytes are a token, and the rank of the
merge is that token's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalbox.llm.common import keep, map_texts
from signalbox.llm.token_counts import Pieces, ends_safely, make_room

#: Words, and pieces between safe spaces, whose ids a worker remembers; beyond it forgets those that it learnt first.
MEMORY = 500_000
#: Words of one recursion: the sum of their squared lengths, which bounds the rows of all its steps.
RECURSION_ROWS = 1_000_000
#: Bytes of texts that are encoded at a time, and tokens that are decoded in one query; a longer text is one for itself.
TEXT_BYTES, DECODE_TOKENS = 2 << 20, 1 << 17
#: Pieces that the pattern splits in one call.
SPLIT_PIECES = 1000
#: Longer words take another recursion, which contracts many pairs a step and keeps at most so many steps at a time.
LONG_WORD, LONG_STEPS = 256, 32

ENCODE = """
WITH RECURSIVE step(word, place, token, size, round) AS (
  SELECT word, place, token, size, 0 FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT a.word, a.place + a.size AS gone, m.size, m.token * 4294967296 + a.place AS best
     FROM step a JOIN step b ON b.place = a.place + a.size JOIN merges m ON m.pair = a.token * 65536::BIGINT + b.token),
   chosen AS (SELECT word, min(best) AS best, arg_min(gone, best) AS gone, arg_min(size, best) AS size FROM pairs GROUP BY word)
   SELECT s.word, s.place,
          CASE WHEN s.place = c.best % 4294967296 THEN (c.best // 4294967296)::INTEGER ELSE s.token END,
          CASE WHEN s.place = c.best % 4294967296 THEN c.size ELSE s.size END, s.round + 1
   FROM step s JOIN chosen c ON s.word = c.word WHERE s.place <> c.gone)
)
SELECT s.word, s.token FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
ORDER BY s.word, s.place
"""
# For long words: all places of the smallest pair at once, unless its token has a merge of a smaller rank, which would
# have to come first. Places that overlap (aaaa) are taken left to right, every second one of a run. Why that is the
# same: contracting the leftmost smallest pair (rank r) makes the token t, and the only new pairs are those of t with its
# neighbours. If no merge of t has a rank below r (``alone`` is false), the smallest pair of the next step is again of
# rank r, and the leftmost of them is the next place that doesn't overlap; by induction all places of r come
# before anything else. If t has such a merge, only the first place is taken, which is the plain step.
ENCODE_LONG = f"""
WITH RECURSIVE step(word, place, token, size, round) AS (
  SELECT word, place, token, size, 0 FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT a.word, a.place, a.place + a.size AS gone, m.token, m.size, m.alone
     FROM step a JOIN step b ON b.place = a.place + a.size JOIN merges m ON m.pair = a.token * 65536::BIGINT + b.token
     WHERE a.round < {LONG_STEPS}),
   smallest AS (SELECT word, min(token) AS token FROM pairs GROUP BY word),
   heads AS (
     SELECT p.*, coalesce(lag(p.gone) OVER (PARTITION BY p.word ORDER BY p.place) = p.place, false) AS follows,
            row_number() OVER (PARTITION BY p.word ORDER BY p.place) AS number
     FROM pairs p JOIN smallest s ON p.word = s.word AND p.token = s.token),
   runs AS (SELECT *, number - max(CASE WHEN follows THEN 0 ELSE number END) OVER (PARTITION BY word ORDER BY place) AS within FROM heads),
   chosen AS (SELECT * FROM runs WHERE number = 1 OR NOT alone AND within % 2 = 0)
   SELECT s.word, s.place, coalesce(c.token, s.token), coalesce(c.size, s.size), s.round + 1
   FROM step s JOIN smallest w ON s.word = w.word LEFT JOIN chosen c ON s.place = c.place
   WHERE s.place NOT IN (SELECT gone FROM chosen))
)
SELECT s.word, s.place, s.token, s.size, s.round
FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) ORDER BY s.word, s.place
"""
DECODE = "SELECT list(bytes ORDER BY place) AS bytes FROM ids JOIN vocabulary USING (token)"


def _runs(values: pa.Array, starts: np.ndarray) -> list[bytes]:
    """The joined bytes of neighbouring values, from one start to the next."""
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int64)[values.offset :][starts].tolist() if len(values) else [0] * len(starts)
    data = memoryview(data or b"")
    return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


class Codec:
    """Encodes and decodes by the ranks in a file and a split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.ranks, self.match = ranks, regex.compile(pattern).findall
        self.byte_tokens = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        cuts = [(ranks[t[:i]], ranks[t[i:]], r, len(t)) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, token, size = np.array(cuts, np.int64).T
        least = np.full(max(ranks.values()) + 1, 1 << 40)
        np.minimum.at(least, left, token)
        np.minimum.at(least, right, token)
        self._first_pairs(left, right, token, least)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self._table("merges", pair=pa.array(left * 65536 + right), token=pa.array(token.astype(np.int32)), size=pa.array(size.astype(np.int32)), alone=pa.array(least[token] < token))
        self._table("vocabulary", token=pa.array(ranks.values(), pa.int32()), bytes=pa.array(ranks.keys(), pa.binary()))
        self.words: dict[str, bytes] = {}  # words of pieces that hold several; one that is a whole piece is kept there alone
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}  # pieces after a space, kept without it

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _first_pairs(self, left: np.ndarray, right: np.ndarray, token: np.ndarray, least: np.ndarray) -> None:
        """For two bytes: their merge, and the least merge of the left one with a token that ends so, or of the right one."""
        never = 1 << 40
        raw = {rank: word for word, rank in self.ranks.items()}
        heads, tails = np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)
        byte = np.full(len(least), -1)
        for rank, word in raw.items():
            heads[rank], tails[rank] = word[0], word[-1]
        byte[self.byte_tokens] = np.arange(256)
        self.pair, self.to_left, self.to_right = (np.full((256, 256), never) for _ in range(3))
        both, last, first = (byte[left] >= 0) & (byte[right] >= 0), byte[right] >= 0, byte[left] >= 0
        sure = both & (least[token] > token)
        self.pair[byte[left[sure]], byte[right[sure]]] = token[sure]
        np.minimum.at(self.to_left, (tails[left[last]], byte[right[last]]), token[last])
        np.minimum.at(self.to_right, (byte[left[first]], heads[right[first]]), token[first])

    def _surely(self, data: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places of bytes that surely merge with the next byte, so that this may be done before anything else.

        They do if their merge (rank r) comes before any merge that could take one of them away, given the bytes next to
        them, and their token has no merge before r: then up to r nothing else depends on whether they have merged yet.
        Two such places never overlap, since each would have to come before the other.
        """
        merge = np.where(number[:-1] == number[1:], self.pair[data[:-1], data[1:]], 1 << 40)
        same = np.concatenate([[False], number[:-1] == number[1:], [False]])
        around = np.concatenate([[0], data, [0]])
        before = np.where(same[:-2], self.to_left[around[:-3], around[1:-2]], 1 << 40)
        behind = np.where(same[2:], self.to_right[around[2:-1], around[3:]], 1 << 40)
        return np.flatnonzero((merge < before) & (merge < behind))

    def _contract(self, words: list[str], raw: list[bytes], long: bool = False) -> None:
        """Learns the ids of words that aren't a token by themselves."""
        sizes = np.array([len(b) for b in raw])
        number = np.repeat(np.arange(len(raw)), sizes)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        # A word's bytes have places in a row, and one place is free between words, so no pair spans two words.
        state = pa.table({
            "word": number.astype(np.int32), "place": np.arange(len(joined), dtype=np.int64) + number,
            "token": self.byte_tokens[joined], "size": np.ones(len(joined), np.int32),
        })
        if not long:
            at = self._surely(joined, number)
            token, size, stays = self.byte_tokens[joined], np.ones(len(joined), np.int32), np.ones(len(joined), bool)
            token[at], size[at], stays[at + 1] = self.pair[joined[at], joined[at + 1]], 2, False
            state = state.set_column(2, "token", pa.array(token)).set_column(3, "size", pa.array(size)).filter(pa.array(stays))
        while len(state):
            self.db.register("bytes", state)
            out = self.db.sql(ENCODE_LONG if long else ENCODE).to_arrow_table()
            self.db.unregister("bytes")
            word, token = (out.column(c).to_numpy() for c in ("word", "token"))
            ended = np.ones(len(word), bool)
            if long:  # what has used up its steps goes on from where it is
                ended = out.column("round").to_numpy() < LONG_STEPS
                state = out.filter(pa.array(~ended)).select(["word", "place", "token", "size"])
            word, data = word[ended], token[ended].astype("<u4").tobytes()
            starts = np.flatnonzero(np.diff(word, prepend=-1)).tolist()
            for number, start, end in zip(word[starts].tolist(), starts, [*starts[1:], len(word)]):
                self.words[words[number]] = data[4 * start : 4 * end]
            if not long:
                break

    def _learn_words(self, new: list[str]) -> None:
        words, raw, held = [], [], 0
        for w in new:
            b = w.encode()
            rank = self.ranks.get(b)
            if rank is not None:
                self.words[w] = rank.to_bytes(4, "little")
            elif len(b) > LONG_WORD:
                self._contract([w], [b], long=True)
            else:
                words.append(w)
                raw.append(b)
                held += len(b) ** 2
                if held >= RECURSION_ROWS:
                    self._contract(words, raw)
                    words, raw, held = [], [], 0
        if words:
            self._contract(words, raw)

    def _split(self, pieces: list[str]) -> list[list[str]]:
        """The words of pieces that may stand one behind the other in a text."""
        words = self.match("".join(pieces))
        ends, wanted = np.cumsum(list(map(len, words))), np.cumsum(list(map(len, pieces)))
        last = np.searchsorted(ends, wanted)
        if not words or ends[-1] != wanted[-1] or (ends[last] != wanted).any():  # a word spans two pieces, or something is no word
            return [self.match(p) for p in pieces]
        cuts = [0, *(last + 1).tolist()]
        return [words[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, known: dict[str, bytes], new: list[str], lead: str) -> None:
        # Before the space of the next one, a piece with a safe end is cut off in any text.
        safe = [p for p in new if ends_safely(p)] if lead else []
        whole: dict[str, str] = {}  # pieces that are one word
        cut = {p: self.match(lead + p) for p in (new if len(safe) < len(new) else []) if not lead or not ends_safely(p)}
        for i in range(0, len(safe), SPLIT_PIECES):
            for p, words in zip(safe[i : i + SPLIT_PIECES], self._split([lead + p for p in safe[i : i + SPLIT_PIECES]]), strict=True):
                if len(words) == 1 and words[0] == lead + p:
                    whole[p] = words[0]
                else:
                    cut[p] = words
        wanted = {w for words in cut.values() for w in words}
        unknown = wanted - self.words.keys()
        alone = [w for w in whole.values() if w not in self.words and w not in unknown]
        if len(self.words) + len(unknown) + len(alone) > MEMORY:
            make_room(self.words, wanted.union(whole.values()), MEMORY)
        for w in unknown:
            ids = self.later.get(w[1:]) if w[:1] == " " else None
            if ids is not None and self.match(w) == [w]:
                self.words[w] = ids
            else:
                alone.append(w)
        self._learn_words(alone)
        for p, words in cut.items():
            known[p] = b"".join([self.words[w] for w in words])
        for p, w in whole.items():
            known[p] = self.words.pop(w)  # a word that is a whole piece is kept there alone

    def _ids(self, known: dict[str, bytes], pieces: list[str], lead: str) -> list[bytes]:
        """The ids of different pieces, remembered or learnt."""
        found = list(map(known.get, pieces))
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if new:
            if len(known) + len(new) > MEMORY:
                make_room(known, set(pieces), MEMORY)
            self._learn(known, new, lead)
            found = [known[p] if ids is None else ids for p, ids in zip(pieces, found)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        cut, ids = Pieces(texts), []
        number = np.empty(len(cut.at), np.int64)
        for known, where, lead in ((self.first, cut.leads, ""), (self.later, ~cut.leads, " ")):
            used = cut.used(where)
            of_word = np.zeros(len(cut.words), np.int64)
            of_word[used] = np.arange(len(ids), len(ids) + len(used))
            number[where] = of_word[cut.at[where]]
            ids += self._ids(known, [cut.words[i] for i in used], lead)
        return _runs(pa.array(ids, pa.large_binary()).take(pa.array(number)), cut.starts)

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """For each text's ids its bytes."""
        out, start, held = [], 0, 0
        for i, b in enumerate(encoded):
            if start < i and held + len(b) // 4 > DECODE_TOKENS:
                out += self._decode(encoded[start:i])
                start, held = i, 0
            held += len(b) // 4
        return out + self._decode(encoded[start:])

    def _decode(self, encoded: list[bytes]) -> list[bytes]:
        tokens = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        if not len(tokens):
            return [b""] * len(encoded)
        self.db.register("ids", pa.table({"place": np.arange(len(tokens), dtype=np.int32), "token": tokens}))
        found = self.db.sql(DECODE).to_arrow_table().column("bytes").combine_chunks().flatten().cast(pa.large_binary())
        self.db.unregister("ids")
        if len(found) != len(tokens):
            raise ValueError("an id isn't in the vocabulary")
        return _runs(found, np.cumsum([0] + [len(b) // 4 for b in encoded]))


def codec(path: str, pattern: str) -> Codec:
    """A Python worker that runs several tasks remembers their words."""
    return keep(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds token_ids (array<int>, if ``with_ids``), n_tokens, ids_sha256 and decoded_sha256.

    The ids are digested as little-endian unsigned 32-bit integers, the decoded bytes as they are. Null and
    empty texts have no tokens and the digests of nothing. Input columns of these names are replaced; repeated
    rows are encoded each for itself; an empty table stays empty.
    """

    def work() -> Callable[[list[str]], list]:
        coder = codec(path, pattern)

        def step(texts: list[str]) -> list:
            encoded = coder.encode(texts)
            decoded = coder.decode(encoded)
            sha = lambda blobs: [hashlib.sha256(b).hexdigest() for b in blobs]
            made = [[len(b) // 4 for b in encoded], sha(encoded), sha(decoded)]
            if with_ids:
                ends = np.cumsum([0] + made[0]).astype(np.int32)
                made.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(encoded), "<i4")))
            return made

        return step

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    return map_texts(df, text, fields, work, ("bpe", path, pattern), TEXT_BYTES)
