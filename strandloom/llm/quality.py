"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document.

A document's features are its words, pairs of neighbouring words, and runs of 3 and 4 bytes, each hashed into one of
2**BITS buckets. Every bucket has a learned vector; their average over all features of the whole text goes through a
linear layer and softmax. Vectors and layer are trained by numpy stochastic gradient descent on a bounded sample:
at most TRAIN_ROWS labelled rows, those whose doc_id hashes lowest, and of these no more than have TRAIN_BUCKETS buckets
together, so the driver's work is the same at any size. Their buckets are counted where the rows are; no text is collected.

Since the layer is linear, scoring needs one number per bucket (its vector times the layer), a table of fixed size
that is broadcast; then each task scores its rows in one pass, and no text is shuffled.

Defined cases: a null or empty text has no feature and gets the bias's score; a null doc_id counts as empty text for
holding out; several labels of one doc_id are averaged (a tie is 1), null labels are ignored; repeated rows get equal
scores; a column of docs named as the output is replaced; without labels, or with labels of one kind, every score is the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, free_name, remainder, table
from .textbytes import NON_BLANK, prefix_hash, span_hash, text_chunks, window_hash, word_spans

BITS, DIM, EPOCHS, RATE = 18, 8, 4, 0.4
TRAIN_ROWS, TRAIN_BUCKETS = 4000, 20_000_000
THRESHOLD = 0.7
#: Tasks that count the buckets of the rows to learn from.
PARTS = 64
_MASK = (1 << BITS) - 1


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, starts) per family; starts[r]:starts[r+1] are row r's buckets."""
    rows = len(offsets) - 1
    starts, ends, row, _ = word_spans(data, offsets, NON_BLANK)
    words = span_hash(prefix_hash(data), starts, ends)
    yield (words & np.uint64(_MASK)).astype(np.int32), np.searchsorted(row, np.arange(rows + 1))
    pairs = np.flatnonzero(row[1:] == row[:-1])
    yield (window_hash(words, 2)[pairs] & np.uint64(_MASK)).astype(np.int32), np.searchsorted(row[pairs], np.arange(rows + 1))
    wide = data.astype(np.uint32)
    for n, k in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        if len(data) < n:
            continue
        h = wide[: len(data) - n + 1].copy()
        for j in range(1, n):
            h = h << np.uint32(8) | wide[j : len(data) - n + 1 + j]
        h = (h * np.uint32(k)) >> np.uint32(32 - BITS)
        # Runs that begin less than n bytes before a row's end would cross it.
        size = np.maximum(np.diff(offsets) - n + 1, 0)
        keep = np.ones(len(h), bool)
        for j in range(1, n):
            edge = offsets[1:-1] - j
            keep[edge[(edge >= 0) & (edge < len(h))]] = False
        yield h[keep].astype(np.int32), np.concatenate([[0], np.cumsum(size)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def bags(docs: DataFrame, text: str) -> DataFrame:
    """docs with n, how many distinct buckets the text has, their steps and their counts, as compressed little-endian numbers of 32 bits."""
    names = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            out = []
            for _, data, offsets in text_chunks(batch.column(text)):
                families = list(features(data, offsets))
                for r in range(len(offsets) - 1):
                    b, c = np.unique(np.concatenate([np.zeros(0, np.int32), *(f[s[r] : s[r + 1]] for f, s in families)]), return_counts=True)
                    out.append((len(b), *(pa.compress(x.astype("<u4").tobytes(), "zstd", asbytes=True) for x in (np.diff(b, prepend=0), c))))
            n, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], [*names, "n", "buckets", "counts"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[x] for x in names), T.StructField("n", T.LongType()), T.StructField("buckets", T.BinaryType()), T.StructField("counts", T.BinaryType())]))


def bag_of(n: int, buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a row of bags."""
    b, c = (np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), "<u4") if n else np.zeros(0, np.uint32) for x in (buckets, counts))
    return np.cumsum(b).astype(np.int32), (c / max(1, c.sum())).astype(np.float32)


def train(bag: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The number of each bucket, and the bias; score = sigmoid(mean + bias). bag: (buckets, shares) of each row."""
    y = np.array(labels, int)
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    step, steps = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - step / steps)
            step += 1
            b, w = bag[i]
            mean = w @ vectors[b]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # A document's step moves its average by the rate, however many features share it.
            if len(b):
                vectors[b] -= (rate / float(w @ w)) * w[:, None] * (layer @ p)[None, :]
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_of: int = 4, held_out: int = 2, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """docs(doc_id, text), labels(doc_id, label); rows whose crc32(doc_id) mod held_out_of is held_out teach nothing."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), held_out_of) != held_out))
    chosen = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows ids: small enough to broadcast whatever the number of labels.
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")
    mine = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(train_rows)
    counted = cut(bags(mine.repartition(PARTS), "text"))
    # Over at most train_rows rows.
    so_far = F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = counted.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_BUCKETS).orderBy(*order).collect()
    return train([bag_of(r.n, r.buckets, r.counts) for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double `out`, the probability of label 1."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches):
        numbers, bias = shared.value
        for batch in batches:
            scores = []
            for _, data, offsets in text_chunks(batch.column(text)):
                total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                for buckets, starts in features(data, offsets):
                    total += _sums(numbers[buckets], starts)
                    count += np.diff(starts)
                # Rounded, as a sum's last digits depend on what else is in the chunk.
                scores.append(np.round(1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias))), 9))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), out=name).where(F.col(name) >= threshold).drop(name)


def predicted(value: Column) -> Column:
    return (value >= THRESHOLD).cast("int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
