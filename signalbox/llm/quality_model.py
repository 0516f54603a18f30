"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax output.

Features of a text are its words, neighbouring word pairs and character n-grams of three to five inside words with
their bounds marked, hashed into a fixed number of buckets. Every bucket has a learned vector; a document is the average of its features' vectors, and a
softmax layer turns it into class probabilities. Training is minibatch stochastic gradient descent in numpy, in one
task, on a sample of labelled rows that a parameter bounds. The output layer is linear, so for scoring the
learned table shrinks to one number for each bucket, and documents are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import body, keep_others, let_go, map_texts

BUCKET_BITS, DIMENSIONS, GRAMS = 17, 12, (3, 4, 5)
BATCH, RATE, SEED = 32, 50.0, 11
#: Passes over the training rows; few rows get more, up to at least so many minibatches.
EPOCHS, MIN_STEPS = 3, 200
#: The most labelled rows of each class that are trained on.
MAX_ROWS_PER_CLASS = 1500
#: Characters of a text that are turned into features at a time, and more up to the end of a word.
PIECE = 1 << 19

#: What stands before and after a word: no characters.
_BEGIN, _END = 0x110001, 0x110002
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")
_MIX = np.uint32(0x85EBCA6B)
_STEP = np.uint32(0x01000193)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _MIX
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def features(piece: str, before: np.uint32 | None = None) -> tuple[np.ndarray, np.uint32 | None]:
    """Bucket numbers of one piece of text, repeats included, and the hash of its last word.

    ``before`` is the last word of the piece before: pairs of words reach over the seam.
    """
    x = np.frombuffer(piece.encode("utf-32-le"), "<u4")
    inside = ~((x == 32) | (x - np.uint32(9) < np.uint32(5)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int32), before
    # All words in a row, each between its marks.
    sizes = ends - starts + 2
    word = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes)
    place = np.arange(len(word)) - (last - sizes)[word]
    codes = np.empty(len(word), np.uint32)
    codes[(place > 0) & (place < sizes[word] - 1)] = x[inside]
    codes[place == 0], codes[last - 1] = _BEGIN, _END
    out, rolled = [], codes
    for n in range(2, max(GRAMS) + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * _STEP ^ codes[n - 1 :]
        if n in GRAMS:
            out.append(_bucket(rolled[word[: len(rolled)] == word[n - 1 :]], n))
    # A word's hash is a sum over its characters, each mixed with its place in the word.
    mixed = (codes * np.uint32(0x27D4EB2F) + place.astype(np.uint32) * np.uint32(0x165667B1)) * _MIX
    mixed = mixed ^ (mixed >> np.uint32(15))
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mixed, dtype=np.uint32)])
    words = total[last] - total[last - sizes]
    out.append(_bucket(words, 1))
    row = words if before is None else np.concatenate([np.array([before], np.uint32), words])
    out.append(_bucket(row[:-1] * _STEP ^ row[1:], 6))
    # A word pair of equal words is also one feature of its own, whatever the word.
    out.append(np.full(int((row[:-1] == row[1:]).sum()), _bucket(np.ones(1, np.uint32), 7)[0], np.int32))
    return np.concatenate(out), words[-1]


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        space = _SPACE.search(text, at + PIECE)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def all_features(text: str) -> Iterator[np.ndarray]:
    """The features of a text, piece by piece; the same for every length of the pieces."""
    before = None
    for piece in pieces(text):
        found, before = features(piece, before)
        yield found


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, each once, and their shares of all its features."""
    count = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in all_features(text):
        count += np.bincount(found, minlength=len(count))
    buckets = np.flatnonzero(count)
    return buckets.astype(np.int32), (count[buckets] / max(1, count.sum())).astype(np.float32)


class Bags:
    """Bags in a nameless file in the task's temporary folder, read one at a time; memory holds their places alone."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), []

    def append(self, buckets: bytes, shares: bytes) -> None:
        self.places.append((self.file.tell(), len(buckets)))
        self.file.write(buckets)
        self.file.write(shares)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, size = self.places[i]
        self.file.seek(at)
        raw = self.file.read(2 * size)  # int32 and float32: as many bytes of each
        self.file.seek(0, 2)
        return np.frombuffer(raw[:size], "<i4"), np.frombuffer(raw[size:], "<f4")


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Fits vectors and output layer; returns each bucket's contribution to the logit of class 1, and the bias.

    Only one minibatch's bags are held at a time.

    The order of the rows doesn't matter if they come sorted; the same rows give the same model.
    """
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    order = random.permutation(len(bags))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    epochs = max(EPOCHS, -(-MIN_STEPS // len(batches)))
    steps, done = epochs * len(batches), 0
    for _ in range(epochs):
        for b in random.permutation(len(batches)):
            rows = batches[b]
            held = [bags[r] for r in rows]
            used, column = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            line, share = np.repeat(np.arange(len(rows)), [len(h[0]) for h in held]), np.concatenate([h[1] for h in held])
            rate = RATE * (1 - done / steps)
            done += 1
            x = np.zeros((len(rows), len(used)), np.float32)
            x[line, column] = share
            mean = x @ vectors[used]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weights[rows][:, None] / len(rows)
            back = p @ layer.T
            layer -= rate * (mean.T @ p)
            bias -= rate * 0.1 * p.sum(0)
            vectors[used] -= rate * (x.T @ back)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


class Model:
    """A fitted table: what a feature adds to the logit of class 1, and the bias."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias

    def probability(self, text: str) -> float:
        """Softmax probability of class 1; an empty text has the bias alone."""
        total, count = 0.0, 0
        for found in all_features(text):
            total += float(self.table[found].sum(dtype=np.float64))
            count += len(found)
        logit = total / max(1, count) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows_per_class: int = MAX_ROWS_PER_CLASS) -> Model:
    """Fits on ``labels`` (key, label 0 or 1), joined to the texts by the key.

    Of each class at most ``rows_per_class`` labelled rows are used: the first by a hash of the key, so the sample
    doesn't depend on order or partitioning; weights restore the classes' shares of all labelled rows. Null keys
    and labels other than 0 and 1 don't count; of several labels of a key the smallest counts, of several texts the
    first in order. Without rows of both classes every text gets the share of class 1.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isin(0, 1)).groupBy("key").agg(F.min("label").alias("label"))
    )
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n = [shares.get(0, 0), shares.get(1, 0)]
    flat = Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log((n[1] + 1) / (n[0] + 1))))
    if not all(n):
        return flat
    order = F.xxhash64(F.col("key").cast("string"))
    sample = None
    for c in (0, 1):  # bounded: a top-k for each class
        rows = known.filter(F.col("label") == c).orderBy(order, "key").limit(rows_per_class)
        sample = rows if sample is None else sample.unionAll(rows)
    texts = df.select(F.col(f"`{key}`").alias("key"), body(text).alias("text"))
    labelled = texts.join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def bags() -> Callable[[list[str]], list]:
        def step(batch: list[str]) -> list:
            made = [bag(t) for t in batch]
            return [[b.astype("<i4").tobytes() for b, _ in made], [s.astype("<f4").tobytes() for _, s in made]]

        return step

    weight = [n[c] / min(n[c], rows_per_class) for c in (0, 1)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rows, y = Bags(), []
        for batch in batches:
            for i in range(batch.num_rows):
                rows.append(batch.column("buckets")[i].as_py(), batch.column("shares")[i].as_py())
                y.append(batch.column("label")[i].as_py())
        if len(set(y)) < 2:
            return
        y = np.array(y, np.int64)
        w = np.array([weight[c] for c in y], np.float32)
        table, bias = train(rows, y, w / w.mean())
        yield pa.RecordBatch.from_pydict({"table": [table.astype("<f4").tobytes()], "bias": [bias]})

    fitted = (
        map_texts(labelled, "text", "buckets binary, shares binary", bags)
        .select(order.alias("order"), "label", "buckets", "shares").repartition(1).sortWithinPartitions("order", "label", "buckets")
        .mapInArrow(learn, "table binary, bias double").collect()
    )
    return Model(np.frombuffer(fitted[0]["table"], "<f4"), fitted[0]["bias"]) if fitted else flat


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (probability of class 1) and predicted (1 from ``threshold`` on).

    Null and empty texts have no features and the score of the bias. Input columns of these names are replaced, others
    stay; repeated rows are scored each for itself; an empty table stays empty; a long text is read piece by piece.
    """

    def work() -> Callable[[list[str]], list]:
        return lambda texts: [[model.probability(t) for t in texts]]

    scored = map_texts(df, text, "score double", work)
    return scored.select(*keep_others(scored, ["score", "predicted"]), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
