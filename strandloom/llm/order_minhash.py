"""Order MinHash fingerprints: by each of many hash functions the least of a text's numbered k-mers are taken, put back
into text order and hashed as a tuple. Two texts agree in a tuple if they share those k-mers in that order, so moved and
edited passages lower the likeness, not changed sets only.

Fingerprints are a map over texts. A text's neighbour is found by cutting the ids into ranges, each sorted and read as a
stream, to which the first row of the range behind it is added; so texts are shuffled once and no order is taken in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textbytes import mix64

#: Code points in a k-mer, k-mers in a tuple, and tuples.
K, TUPLE, TUPLES = 6, 2, 64
#: Code points hashed together, k-mers compared together, and the ranges of ids and what of their ids is looked at.
CHUNK_CHARS, COLUMNS = 1 << 17, 1 << 14
PART_BYTES, MOST_PARTS, IDS_A_PART = 64 << 20, 20_000, 64
_U = np.uint64
_PAD = 0x110000  # no code point
_MULTIPLY = (mix64(np.arange(1, TUPLES + 1, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_LAST = 1 << 32  # behind every value


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _numbered(strings: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of (text, tail, shared) with their number among equal ones, laid end to end, and how many each text and
    each tail has. A tail stands for another text, whose first `shared` k-mers are the text's."""
    parts, counts = [], []
    for text, tail, _ in strings:
        for x in (text, tail):
            parts.append(x)
            counts.append(max(0, len(x) - K + 1))
    laid, sizes, counts = np.concatenate(parts), np.array([len(p) for p in parts]), np.array(counts)
    letters = mix64(laid.astype(_U) + _U(0x9E3779B97F4A7C15))
    whole = np.zeros(max(0, len(laid) - K + 1), _U)
    for j in range(K):
        whole = whole * _U(0xD6E8FEB86659FD93) + letters[j : j + len(whole)]
    # Of all places those whose k-mer lies within one string.
    begins = np.cumsum(sizes) - sizes
    firsts = np.cumsum(counts) - counts
    hashes = mix64(whole[np.arange(counts.sum()) + np.repeat(begins - firsts, counts)])
    row = np.repeat(np.arange(len(counts)) >> 1, counts)
    key = mix64(hashes + mix64(row.astype(_U) + _U(1)))
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(order) else np.zeros(0, bool)
    # Only k-mers that occur again need their places in order.
    at = np.sort((group[several].astype(np.int64) << 32) | order[several].astype(np.int64))
    group, place = at >> 32, at & 0xFFFFFFFF
    rank = np.arange(len(at)) - np.searchsorted(group, group)
    # A k-mer of a tail is numbered behind the shared ones only, not behind those of the text's own end.
    within = place - firsts[np.repeat(np.arange(len(counts)), counts)[place]] if len(at) else place
    tail = np.repeat(np.arange(len(counts)) & 1, counts)[place].astype(bool)
    shared = np.array([s for _, _, s in strings])[row[place]] if len(at) else place
    own_end = np.append(0, np.cumsum(~tail & (within >= shared)))
    edge = np.searchsorted(group, group), np.searchsorted(group, group, "right")
    number = np.zeros(len(hashes), _U)
    number[place] = np.where(tail, rank - (own_end[edge[1]] - own_end[edge[0]]), rank).astype(_U)
    return mix64(hashes + number * _U(0x9E3779B97F4A7C15)), counts


def _least(hashes: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, places): for each function the TUPLE least values and where they stand, in order of value, then place."""
    out = np.full((TUPLES, 0), _LAST, np.int64), np.zeros((TUPLES, 0), np.int64)
    narrow, every = hashes.astype(np.uint32), np.arange(TUPLES)
    for at in range(0, len(narrow), COLUMNS):
        values = _MULTIPLY[:, None] * narrow[None, at : at + COLUMNS]
        found, places = [], []
        for k in range(min(TUPLE, values.shape[1])):
            # A value that was taken is put last; where only such are left, a later one has no other place.
            place = values.argmin(axis=1)
            found.append(values[every, place].astype(np.int64))
            places.append(place + at + offset)
            values[every, place] = 0xFFFFFFFF
        out = _met(out, (np.stack(found, 1), np.stack(places, 1)))
    return out


def _met(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    values, places = np.hstack([one[0], two[0]]), np.hstack([one[1], two[1]])
    if values.shape[1] <= TUPLE and not one[0].shape[1]:
        return values, places
    order = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
    return np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)


def _tuples(least: tuple, hashes: np.ndarray) -> np.ndarray:
    """The fingerprint: a number for each function, of the k-mers taken in text order."""
    places = np.sort(least[1], axis=1)
    out = mix64(np.arange(TUPLES, dtype=_U) + _U(places.shape[1] << 8))
    for k in range(places.shape[1]):
        out = mix64(out * _U(0xD6E8FEB86659FD93) + hashes[places[:, k]])
    return (out >> _U(32)).astype(np.uint32)


def fingerprints(texts: list[str], edited: list[str | None], shared: list[int]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Fingerprints of texts and of their edited texts (None: not asked for), which begin with the same `shared` code points. A
    text of fewer than K code points is one k-mer."""
    strings = []
    padded = lambda x: np.append(x, np.full(max(0, K - len(x)), _PAD, np.uint32)) if len(x) < K else x
    for text, other, same in zip(texts, edited, shared):
        both = max(0, same - K + 1) if other is not None and len(other) >= K else 0
        tail = np.zeros(0, np.uint32) if other is None else padded(_codes(other)) if len(other) < K else _codes(other[both:])
        strings.append((padded(_codes(text)), tail, both))
    hashes, counts = _numbered(strings)
    ends = np.cumsum(counts)
    mine, theirs = [], []
    for k, (_, _, both) in enumerate(strings):
        at, mid, end = ends[2 * k] - counts[2 * k], ends[2 * k], ends[2 * k + 1]
        start = _least(hashes[at : at + both], at)
        mine.append(_tuples(_met(start, _least(hashes[at + both : mid], at + both)), hashes))
        theirs.append(None if edited[k] is None else _tuples(_met(start, _least(hashes[mid:end], mid)), hashes))
    return mine, theirs


def _text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text: TUPLES numbers of 8 hex digits. A null text counts as empty, equal texts have equal
    fingerprints, and a column named like the output is replaced."""
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            texts, first, held = [], 0, 0
            for k, x in enumerate(batch.column(text)):
                texts.append(x.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK_CHARS or k == batch.num_rows - 1:
                    found, _ = fingerprints(texts, [None] * len(texts), [0] * len(texts))
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_text(f) for f in found], pa.string())], [*part.schema.names, out])
                    texts, first, held = [], k + 1, 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of tuples in which two fingerprints agree."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("(.{8})"), F.lit(1))
    same = F.size(F.filter(F.zip_with(numbers(a), numbers(b), lambda x, y: x == y), lambda x: x))
    return same / F.lit(float(TUPLES))


def in_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(part, peek, key, text) of docs and the number of parts: ranges of the whole-numbered key, to each of which the row behind its last is
    added with peek true (to the last range, the first row of all). Null keys come first, equal ones go by text.

    The driver gets IDS_A_PART keys a part, at most MOST_PARTS parts, to cut by, and the first key of each part.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(key).cast("long").alias("key"))
    total = ids.agg(F.count(F.lit(1)).alias("n")).first().n
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, max(size // PART_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), total))
    some = ids.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(max(1, total // (IDS_A_PART * parts)))) == 0)).distinct()
    seen = np.sort(np.array([r.key for r in some.collect()], np.int64))
    bounds = np.unique(seen[(np.arange(1, parts) * len(seen)) // parts]) if len(seen) else seen

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = np.zeros(len(keys), np.int32)
        out[known] = np.searchsorted(bounds, keys[known].astype(np.int64), "right")
        return pd.Series(out)

    # Keys go to Python as text, as doubles would stand for nullable whole numbers otherwise.
    dealt = docs.select(part_of(F.col(key).cast("string")).alias("part"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    heads = sorted((r.part, None if r.none else r.key) for r in dealt.groupBy("part").agg(F.min("key").alias("key"), F.max(F.col("key").isNull()).alias("none")).collect())
    if not heads:
        return dealt.select("part", F.lit(False).alias("peek"), "key", "text"), 1
    # A row for each part, so bounded.
    wanted = spark.createDataFrame([(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)], f"part int, key {dict(docs.dtypes)[key]}")
    behind = dealt.drop("part").join(F.broadcast(wanted.withColumnRenamed("key", "head")), F.col("key").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min("key").alias("key"), F.min("text").alias("text"))
    rows = dealt.select("part", F.lit(False).alias("peek"), "key", "text").unionByName(behind.select("part", F.lit(True).alias("peek"), "key", "text"))
    return rows, len(bounds) + 1


def _pairs(batches) -> Iterator[list[tuple]]:
    """Chunks of (key, text) of consecutive rows of a part, the last of which is only the next of the one before it."""
    held, size, at = [], 0, None
    for batch in batches:
        for part, _, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                if len(held) > 1:
                    yield held
                held, size, at = [], 0, part
            held.append((key, text))
            size += len(text)
            if size >= CHUNK_CHARS and len(held) > 1:
                yield held
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield held


NEIGHBOURS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, NEIGHBOURS): each text's fingerprint beside that of its edited text, whose last quarter (rounded down) is replaced by as
    many of the next row's first code points (or all), and beside the next row's, in order of key. After the last comes the first, a
    single row is its own next. Null texts count as empty, null keys come first, rows equal in key go by text;
    repeated rows each give a row. An empty table gives none. Keys are whole numbers; those equal in key stay in one task."""
    laid, parts = in_ranges(docs, key, text)
    dealt = laid.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "peek", "key", "text")

    def run(batches):
        for held in _pairs(batches):
            texts = [t for _, t in held]
            edited, shared = [], []
            for own, after in zip(texts, texts[1:]):
                cut = len(own) // 4
                shared.append(len(own) - cut)
                edited.append(own[: shared[-1]] + after[:cut])
            mine, theirs = fingerprints(texts, [*edited, None], [*shared, 0])
            columns = [
                pa.array([k for k, _ in held[:-1]], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array([_text(f) for f in mine[:-1]], pa.string()), pa.array([_text(f) for f in theirs[:-1]], pa.string()),
                pa.array([float((a == b).mean()) for a, b in zip(mine, theirs[:-1])], pa.float64()), pa.array([float((a == b).mean()) for a, b in zip(mine, mine[1:])], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *(f.split()[0] for f in NEIGHBOURS.split(", "))])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[key].dataType)
    return dealt.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {NEIGHBOURS}")


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
