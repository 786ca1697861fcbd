"""SimHash near-duplicates by ball hashing that meets in the middle.

Fingerprints that differ in at most three of 64 bits link. The bits are dealt into three parts; the part that
holds most of a pair's differing bits is left out in one of three turns, and then at most two differing bits are
left, so half the radius is one. Every fingerprint emits, for each turn, its remaining bits and all variants with
one of them flipped (132 keys in all); fingerprints that share a variant are compared in full. This finds every
pair within the radius and never needs the 2081 variants of a ball of radius two.

Only distinct fingerprints take part, so copies are no work. Within a key, links are a spanning forest found by
comparing whole arrays: no pairs are emitted, and equal keys beyond two members come in sorted runs.
A key holds at most the fingerprints that agree on some 42 bits up to one, whatever the number of documents.

Defined cases: a null or empty text has fingerprint 0, linked like any other; a null doc_id is ignored when the
smallest is sought (null if a component has no other); repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, table
from .components import components
from .textbytes import LOWER, NON_BLANK, text_chunks, word_spans

SHINGLE, SEED, RADIUS = 3, 42, 3
EMITTED = 1_000_000
PARTS = ((0, 22), (22, 43), (43, 64))
_U = np.uint64
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[s:e] for each span: spans of equal length below 32 bytes at once, longer ones one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at4 = np.ndarray(len(padded) - 7, "<u4", padded, strides=(1,))
    out, size = np.empty(len(starts), _U), ends - starts
    short = np.minimum(size, 32).astype(np.uint8)
    for n in np.flatnonzero(np.bincount(short, minlength=33)):
        mine = np.flatnonzero(short == n)
        if n == 32:
            raw = data.tobytes()
            out[mine] = [xxhash.xxh64_intdigest(raw[s:e], seed) for s, e in zip(starts[mine].tolist(), ends[mine].tolist())]
            continue
        p, left = starts[mine].copy(), int(n)
        h = np.full(len(mine), (seed + int(_P5) + left) % 2**64, _U)
        while left >= 8:
            h ^= _rotl(at8[p] * _P2, 31) * _P1
            h = _rotl(h, 27) * _P1 + _P4
            p, left = p + 8, left - 8
        if left >= 4:
            h ^= at4[p].astype(_U) * _P1
            h = _rotl(h, 23) * _P2 + _P3
            p, left = p + 4, left - 4
        for _ in range(left):
            h ^= padded[p].astype(_U) * _P5
            h = _rotl(h, 11) * _P1
            p = p + 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        out[mine] = h ^ (h >> _U(32))
    return out


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row's text."""
    starts, ends, row, inside = word_spans(LOWER[data], offsets, NON_BLANK)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(rows, _U)
    size = ends - starts
    after = np.cumsum(size + 1)
    begin = after - size - 1
    spaced = np.full(int(after[-1]), 0x20, np.uint8)
    letters = np.ones(len(spaced), bool)
    letters[after - 1] = False
    spaced[letters] = LOWER[data][inside]
    stop = after - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < shingle))
    full = np.flatnonzero(row[: max(0, len(row) - shingle + 1)] == row[shingle - 1 :]) if len(row) >= shingle else np.zeros(0, int)
    head = np.concatenate([full, first[few]])
    tail = np.concatenate([full + shingle - 1, first[few] + count[few] - 1])
    order = np.argsort(row[head], kind="stable")
    head, tail = head[order], tail[order]
    owner = row[head]
    hashed = xxh64_spans(spaced, begin[head], stop[tail])
    ones, total = np.zeros((rows, 64), np.int64), np.bincount(owner, minlength=rows)
    for a in range(0, len(hashed), 1 << 16):
        own = owner[a : a + (1 << 16)]
        bits = np.unpackbits(hashed[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut_at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut_at]] += np.add.reduceat(bits, cut_at, axis=0, dtype=np.int64)
    major = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", out: str = "fp") -> DataFrame:
    """The columns `keep` and the fingerprint as a long with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_rows(d, o) for _, d, o in text_chunks(batch.column(batch.num_columns - 1))]
            fp = np.concatenate(found) if found else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*keep, out])

    last = free_name(docs, "text_to_hash")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.LongType())])
    return docs.select(*keep, F.col(text).alias(last)).mapInArrow(run, schema)


def variant_keys() -> list[tuple[int, int]]:
    """(bits that stay, bits that flip) of each variant; a mark for the turn goes into the flipped bits' column too."""
    full, out = (1 << 64) - 1, []
    for turn, (low, high) in enumerate(PARTS):
        left_out = ((1 << high) - 1) ^ ((1 << low) - 1)
        mark = left_out & (0x5555555555555555 if turn % 2 else 0x3333333333333333) ^ (turn << low)
        out += [(full ^ left_out, mark ^ flip) for flip in [0, *(1 << b for b in range(64) if not low <= b < high)]]
    return [tuple(x - (1 << 64) if x >> 63 else x for x in pair) for pair in out]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, one that it links to) for all but one member of each linked set."""
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            parent = np.full(len(rest), -1)
            for k, one in enumerate(front):  # a member leaves `rest` as soon as one parent is known
                todo = np.flatnonzero(parent < 0)
                if not len(todo):
                    break
                parent[todo[np.bitwise_count(rest[todo] ^ one) <= radius]] = k
            got = parent >= 0
            links += zip(rest[got].view(np.int64).tolist(), front[parent[got]].view(np.int64).tolist())
            front, rest = rest[got], rest[~got]
    return links


def _link_runs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    cut_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut_at, len(key)))
    two = cut_at[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
    more = [x for a, n in zip(cut_at[size > 2].tolist(), size[size > 2].tolist()) for x in _forest(fp[a : a + n], radius)]
    u, v = np.array(more, np.int64).reshape(-1, 2).T
    return np.concatenate([fp[two].view(np.int64), u]), np.concatenate([fp[two + 1].view(np.int64), v])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of linked fingerprints, enough of them to connect all within the radius. fps(fp): distinct."""
    if radius > 3:
        raise ValueError("three parts and balls of radius one find pairs up to radius 3")
    keys = F.array(*[F.struct(F.lit(stay).alias("stay"), F.lit(flip).alias("flip")) for stay, flip in variant_keys()])
    # Each fingerprint becomes 132 rows: tasks by the rows to come, not by those there are.
    spread = fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() * len(variant_keys()) // EMITTED + 1), "fp")
    emitted = spread.select("fp", F.explode(F.transform(keys, lambda k: F.col("fp").bitwiseAND(k["stay"]).bitwiseXOR(k["flip"]))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, _U)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(_U)])
            if not len(key) or key[0] == key[-1]:
                continue
            end = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            u, v = _link_runs(key[:end], fp[:end], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            key, fp = key[end:], fp[end:]
        if len(key):
            u, v = _link_runs(key, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return emitted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]))
    return prints.join(_smallest(prints, F.col("doc_id"), radius), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _smallest(prints: DataFrame, what, radius: int) -> DataFrame:
    """(fp, least): the smallest `what` of each fingerprint's component."""
    classes = cut(prints.groupBy("fp").agg(F.min(what).alias("own")))
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("least"))
    return rooted.join(least, "root").select("fp", "least")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (null last), then of the smallest text hash."""
    h, nought = free_name(docs, "text_hash"), F.lit(0).cast(docs.schema[doc_id].dataType)
    mine = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", nought).alias("i"), F.col("h").alias("h"))
    # A hash of the text tells apart rows of one doc_id; rows equal in both are one.
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    prints = cut(fingerprints(hashed, ["doc_id", "h"]))
    n, i = free_name(docs, "no_id"), free_name(docs, "id_or_0")
    chosen = _smallest(prints, mine, radius).select(F.col("least.n").alias(n), F.col("least.i").alias(i), F.col("least.h").alias(h)).distinct()
    marked = docs.withColumns({n: F.col(doc_id).isNull(), i: F.coalesce(F.col(doc_id), nought), h: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return marked.join(chosen, [n, i, h], "left_semi").dropDuplicates([n, i, h]).select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
