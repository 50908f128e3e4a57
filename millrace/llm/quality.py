"""Quality classifier: supervised subword embeddings.

Words and their byte n-grams (3 to 5, with the word's edges) are hashed into BUCKETS learned vectors; a document is their
average, a softmax over two classes follows, trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. As everything after the look-up is linear, scoring needs one number per bucket: the embedding times the
difference of the output rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Rolling, bounded_batches, canonical, text_blocks, word_bounds

BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 18, 8, 6, 4.0
REPEAT = BUCKETS - 1
#: Labelled rows per class that are learned from, at most: the first by hash of the id, of texts of up to SAMPLE_BYTES.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 50_000
FOLDS = 5
_WORD = Rolling(606)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def bucket_ids(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, of repeats and of n-grams of canonical texts, and where each text's begin and end among them.

    A word that repeats the word before it is also one shared bucket: a word bigram by back-reference.
    """
    data = np.frombuffer(b" " + b" \n ".join(texts) + b" ", np.uint8)
    breaks = np.flatnonzero(data == 10)
    space = (data == 32) | (data == 10)

    def bounds(at: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.searchsorted(at, breaks), [len(at)]))

    h = data.astype(np.uint32)
    inner = np.zeros(len(data), bool)  # a space strictly inside the gram so far; a break has spaces on both sides
    for n in range(2, 6):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
            at = np.flatnonzero(~inner)
            yield ((h[at] + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(14)).view(np.int32), bounds(at)
    start, end = word_bounds(data)
    w = _WORD.ranges(_WORD.sums(data), start, end)
    yield (w >> np.uint64(46)).astype(np.int32), bounds(start)
    again = np.flatnonzero(w[1:] == w[:-1]) + 1
    again = again[start[again] - end[again - 1] == 1]
    yield np.full(len(again), REPEAT, np.int32), bounds(start[again])


class Model:
    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def scores(self, texts) -> np.ndarray:
        out = []
        for _, block in text_blocks([canonical(t) for t in texts]):
            total, count = np.zeros(len(block)), np.zeros(len(block), np.int64)
            for ids, at in bucket_ids(block):
                full = np.flatnonzero(at[1:] > at[:-1])
                if len(full):
                    total[full] += np.add.reduceat(self.weight[ids], at[full], dtype=np.float64)
                count += np.diff(at)
            out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str | None], labels: list[int], seed: int = 11, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent, a document at a time, the rate falling to 0; without rows of both classes, a constant."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 2.0 if len(y) and y[0] else (-2.0 if len(y) else 0.0))
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        ids, n = np.unique(np.concatenate([x for x, _ in bucket_ids([canonical(t)])]), return_counts=True)
        rows.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, k = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            step = rate * (1 - k / steps)
            k += 1
            ids, share = rows[i]
            own = vectors[ids]
            hidden = share @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = error @ out
            out -= step * 0.25 * np.outer(error, hidden)
            bias -= step * 0.02 * error
            # shares are small numbers; scaled by their norm each document moves its vectors alike
            vectors[ids] = own - step * np.outer(share / max(1e-6, float(share @ share) ** 0.5), back) * 0.25
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> tuple[list, list]:
    """At most `rows` labelled documents of each class outside fold 0; of the documents only the sampled ones are collected.

    An id of both labels is not learned from; of the texts of one id the first by hash is.
    """
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(doc_id)) != 0)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y"), F.max(label).cast("int").alias("_z")).where("_y = _z").drop("_z")
    order = [F.xxhash64("_id"), "_id"]
    picked = own.where("_y = 1").orderBy(*order).limit(rows).unionByName(own.where("_y = 0").orderBy(*order).limit(rows))
    short = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where(F.coalesce(F.octet_length("_t"), F.lit(0)) <= SAMPLE_BYTES)
    found = short.join(F.broadcast(picked), F.col("_d") == F.col("_id")).groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).collect()
    found.sort(key=lambda r: r["_id"])
    return [r["_t"] for r in found], [r["_y"] for r in found]


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with `quality_score` added, in [0, 1], higher where label 1 is likelier.

    Only the text enters a score. Null, empty and blank texts get the model's score of no evidence. Labels that are null or not 0 or
    1 are not learned from; with fewer than two classes, or no labels, the score is a constant. Repeated rows score alike. A column
    `quality_score` of the input is replaced.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, doc_id, text, label, rows)))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.value.scores(batch))

    return docs.withColumn("quality_score", F.pandas_udf(scored, "double")(F.col(text)))
