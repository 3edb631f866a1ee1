"""Quality classifier: supervised subword embeddings, averaged per document, under a softmax.

A document's features are its white-space words, its pairs of neighbouring words (by
XOR of their hashes, so that a repeated word always gives the same feature) and its
byte n-grams of 1 to 4, all hashed into ``BUCKETS`` learned vectors of ``DIM`` numbers.
The mean of the vectors goes through a softmax layer over the two labels.

:func:`train` fits vectors and layer by numpy stochastic gradient descent, one document
at a time, on at most ``ROWS`` labelled documents of at most ``BYTES`` together (in the
order of the hashes of their ids; one that no longer fits is left out of the training).
:func:`score` reads whole texts of any length: with both layers linear, a feature adds
one number to the difference of the two labels, so a document needs one table look-up a feature.

Scores don't depend on ids, languages, sources or labels of the rows they are for.
Defined results: a null or empty text has no features and gets the score of the layer's
bias; labels that are null or other than 0 and 1 are not learned from; without any usable
label every score is 0.5, and :func:`good` keeps all documents; repeated rows are scored
one by one, and of several texts of one id the shortest (then the first in order) is learned from; other columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.llm import kernels as K
from kpi_spark.llm.columns import hidden, shown

#: Learned vectors (a power of two) and their length.
BUCKETS, DIM = 1 << 17, 8
#: Labelled documents learned from at most, and their bytes together at most.
ROWS, BYTES = 3000, 8 << 20
#: Passes over them, and the first learning rate, which falls linearly to 0.
EPOCHS, RATE = 8, 0.5
#: Learning rate of the vectors over that of the layer: a vector only moves by its small share in a mean.
SPREAD = np.float32(40)
#: Score from which a document counts as good.
GOOD = 0.7

_GRAMS = (1, 2, 3, 4)
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))


def _word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and where each row's begin; buckets of the word pairs and where each row's begin."""
    words, first = K.word_hashes(buf, off, K.NONSPACE)
    top = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = (K.mix(words) >> top).astype(np.int32)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = row[1:] == row[:-1]
    two = (K.mix((words[1:] ^ words[:-1]) + np.uint64(99)) >> top).astype(np.int32)[same]
    return one, first, two, np.searchsorted(row[1:][same], np.arange(len(first)))


def _gram_features(buf: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last n - 1 have none)."""
    size = max(0, len(buf) - n + 1)
    value = np.zeros(size, np.uint32)
    for k in range(n):
        value = (value << np.uint32(8)) | buf[k : k + size]
    value = value + np.uint32(n * 0x01000193)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    value *= np.uint32(0x297A2D39)
    return (value >> _SHIFT).astype(np.int32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its features that fall in each."""
    buf, off = K.text_buffer(pa.array([text], pa.string()))
    one, _, two, _ = _word_features(buf, off)
    found, count = np.unique(np.concatenate([one, two, *(_gram_features(buf, n) for n in _GRAMS)]), return_counts=True)
    return found, (count / max(1, count.sum())).astype(np.float32)


class Model:
    """What scoring needs: what each bucket adds to the log-odds of label 1, and the bias; examples: how many it was fitted on."""

    def __init__(self, table: np.ndarray, bias: float, examples: int) -> None:
        self.table, self.bias, self.examples = table, bias, examples

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text of a buffer."""
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)

        def add(buckets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            run = np.concatenate(([0.0], np.cumsum(self.table[buckets], dtype=np.float64)))
            total[:] += run[end] - run[begin]
            count[:] += end - begin

        one, first, two, pairs = _word_features(buf, off)
        add(one, first[:-1], first[1:])
        add(two, pairs[:-1], pairs[1:])
        for n in _GRAMS:
            begin = np.minimum(off[:-1], max(0, len(buf) - n + 1))
            add(_gram_features(buf, n), begin, np.maximum(begin, off[1:] - n + 1))
        odds = total / np.maximum(count, 1) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 9)


def fit(examples: list[tuple[str, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent on (text, label) pairs."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    ready = [(*features(t), y) for t, y in examples]
    steps, step = EPOCHS * len(ready), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(ready)).tolist():
            buckets, share, y = ready[k]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = share @ vectors[buckets]
            odds = layer @ mean + bias
            p = np.exp(odds - odds.max())
            delta = p / p.sum()
            delta[y] -= 1
            down = delta @ layer
            layer -= rate * np.outer(delta, mean)
            bias -= np.float32(0.2) * rate * delta
            vectors[buckets] -= (SPREAD * rate) * share[:, None] * down[None, :]
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), len(ready))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, bytes_: int = BYTES) -> Model:
    """A model fitted on the labelled documents that are not held out."""
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where("_text is not null")
    sizes = own.groupBy("_id").agg(F.min(F.octet_length("_text")).alias("_size")).where(F.col("_size") <= bytes_)  # ids and sizes only: texts stay where they are
    usable = wanted.join(sizes, "_id").orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    chosen, total = [], 0
    for r in usable.collect():  # at most ``rows`` small rows
        if total + r["_size"] <= bytes_:
            total += r["_size"]
            chosen.append((r["_id"], r["_size"], r["_label"]))
    if not chosen:
        return fit([])
    side = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _size int, _label int")
    found = own.join(F.broadcast(side.select("_id", "_size").distinct()), "_id").where(F.octet_length("_text") == F.col("_size"))
    texts = {r["_id"]: r["_text"] for r in found.groupBy("_id").agg(F.min("_text").alias("_text")).collect()}
    return fit([(texts[i], y) for i, _, y in sorted(chosen, key=lambda c: (c[0], c[2]))])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``GOOD`` on)."""
    given = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    keep = [c for c in given if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.examples))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            buf, off = K.text_buffer(batch.column(text))
            out = [fitted.scores(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.pieces(off)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, "score"])

    return docs.select(*given).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns; all of them where it was fitted on no usable label."""
    if not model.examples:
        return docs
    return shown(score(hidden(docs, ("score", "predicted")), model).where("predicted = 1"), docs.columns)
