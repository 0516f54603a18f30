"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries: before a single space between two printable characters, where the
pre-tokenizer of a byte-level vocabulary always cuts and no special string can lie. So the count of a text is the
sum over its pieces, a very long text costs no more memory than a short one, and a piece seen before needs no
second encoding. Arrow cuts the texts and numbers their distinct pieces, so Python meets each distinct piece of a slice
of texts once. Unseen pieces go to the library in batches of about equal bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import body, keep, keep_others, map_texts

#: Bytes of pieces in one call of the library, and of pieces in one text of such a call.
BATCH_BYTES, JOINED_BYTES = 256 << 10, 4 << 10
#: Bytes of texts whose pieces are numbered together.
TEXT_BYTES = 8 << 20
#: Pieces whose counts a worker remembers; beyond it forgets those that it learnt first.
MEMORY = 1_000_000
#: A space that is safe to cut at: neither neighbour is white space in any Unicode version. The pattern begins with
#: the space itself, so that the search can skip to the next one.
SAFE_SPACE = re.compile(" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
#: A text with another space, as a pattern for Arrow, which has no way to look at neighbours without taking them.
UNSAFE_SPACE = "(?:^|[^!-~À-ɏ]) | (?:$|[^!-~À-ɏ])"

Value = TypeVar("Value")


def ends_safely(piece: str) -> bool:
    """Whether a space behind this piece, before another one, is safe."""
    return "!" <= piece[-1:] <= "~" or "À" <= piece[-1:] <= "ɏ"


def make_room(known: dict[str, Value], wanted: set[str], most: int) -> None:
    """Keeps what is wanted and the newest half of ``most``, or as much as leaves room for what is wanted."""
    kept = min(most // 2, max(0, most - len(wanted)))
    used = {p: known[p] for p in wanted & known.keys()}
    newest = dict(islice(known.items(), max(0, len(known) - kept), None))
    known.clear()
    known.update(newest)
    known.update(used)


class Pieces:
    """The pieces of some texts: ``words`` has each distinct one, ``at`` the number of each piece's word, text after text."""

    def __init__(self, texts: list[str], cut: bool = True) -> None:
        whole = pa.array(texts, pa.large_string())
        self.starts = np.arange(len(texts) + 1)
        flat = whole
        if cut:
            unsafe = pc.match_substring_regex(whole, UNSAFE_SPACE)
            lists = pc.split_pattern(whole.filter(pc.invert(unsafe)), " ")
            if len(lists) < len(whole):  # the others are cut by SAFE_SPACE, and all are put in order again
                others = pa.array([SAFE_SPACE.split(t) for t in whole.filter(unsafe).to_pylist()], lists.type)
                order = np.argsort(np.argsort(unsafe.to_numpy(zero_copy_only=False), kind="stable"))
                lists = pa.concat_arrays([lists, others]).take(pa.array(order))
            self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            flat = lists.flatten()
        coded = flat.dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.at = coded.indices.to_numpy()
        self.leads = np.zeros(len(self.at), bool)
        self.leads[self.starts[:-1]] = True  # every text has a first piece

    def used(self, where: np.ndarray) -> list[int]:
        """The numbers of the words at these places, each once."""
        found = np.zeros(len(self.words), bool)
        found[self.at[where]] = True
        return np.flatnonzero(found).tolist()


def balanced(pieces: Iterator[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``most`` bytes; a longer piece is a batch of its own."""
    batch, held = [], 0
    for piece in pieces:
        size = len(piece.encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of a batch's encodings, special strings handled as the library does by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(ids) for ids in pieces.encode(batch, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda batch: [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def _cuts_at_spaces(path: str) -> bool:
    """Whether the vocabulary's pre-tokenizer is plain byte-level, for which SAFE_SPACE is proven safe."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre = model.get("pre_tokenizer") or {}
    specials = [t for t in model.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or " " in t["content"]]
    return not specials and not model.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]


def _joined_encoder(path: str) -> Callable[[list[str]], list[int] | None]:
    """Lengths of the encodings of pieces that may stand one behind the other in a text, from one encoding of that text.

    Every token of a byte-level vocabulary stands for known bytes, so the running sum of their sizes tells where each piece
    ends. Where it doesn't end with a token, or a size isn't known, the answer is None.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sizes = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)  # a letter for each byte
    for i, token in tokenizer.get_added_tokens_decoder().items():
        sizes[i] = len(token.content.encode())

    def encode(batch: list[str]) -> list[int] | None:
        ids = tokenizer.encode_batch_fast(["".join(batch)], add_special_tokens=False)[0].ids
        ends, wanted = np.cumsum(sizes[ids]), np.cumsum([len(p.encode()) for p in batch])
        last = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return None
        return np.diff(last, prepend=-1).tolist()

    return encode


class Counter:
    """Counts tokens of texts, remembering the pieces it has met."""

    def __init__(self, path: str) -> None:
        self.encode, self.cut = _encoder(path), _cuts_at_spaces(path)
        self.encode_joined = _joined_encoder(path) if self.cut else None
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}  # pieces after a space, kept without it

    def _learn(self, known: dict[str, int], pieces: set[str], lead: str) -> None:
        new = pieces - known.keys()
        if new and len(known) + len(new) > MEMORY:
            make_room(known, pieces, MEMORY)
        if lead:  # before the space of the next one, a piece with a safe end is cut off in any text
            for batch in balanced(filter(ends_safely, new), JOINED_BYTES):
                counts = self.encode_joined([lead + p for p in batch])
                if counts is not None:
                    known.update(zip(batch, counts, strict=True))
            new = new - known.keys()
        for batch in balanced(iter(new)):
            known.update(zip(batch, self.encode([lead + p for p in batch] if lead else batch), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        cut = Pieces(texts, self.cut)
        counts = np.empty(len(cut.at), np.int64)
        for known, where, lead in ((self.first, cut.leads, ""), (self.later, ~cut.leads, " ")):
            used = cut.used(where)
            words = [cut.words[i] for i in used]
            self._learn(known, set(words), lead)
            count = np.zeros(len(cut.words), np.int64)
            count[used] = [known[w] for w in words]
            counts[where] = count[cut.at[where]]
        return np.add.reduceat(counts, cut.starts[:-1]).tolist()


def counter(path: str) -> Counter:
    """A Python worker that runs several tasks remembers their pieces."""
    return keep(("tokens", path), lambda: Counter(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens above ``limit``) by the vocabulary file at ``path``.

    Null and empty texts have no bytes and no tokens. Input columns of these names are replaced; each row is
    counted for itself, so repeated rows give repeated counts; an empty table stays empty.
    """

    def work() -> Callable[[list[str]], list]:
        count = counter(path)
        return lambda texts: [count(texts)]

    counted = map_texts(df, text, "n_tokens bigint", work, ("tokens", path), TEXT_BYTES)
    others = keep_others(counted, ["n_bytes", "n_tokens", "over_limit"])
    return counted.select(
        *others, F.octet_length(body(text)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
