"""Hard negatives: for each anchor and positive, the best rows of other labels whose score lies in a window below the positive's.

Anchors and candidates are packed into tiles of whole numbers. Tiles meet in cells, an anchor tile and a share of
the candidate tiles each, by an ordinary shuffle; in a cell, tiles are multiplied by Strassen's recursion and heaps of the best
scores are kept for each anchor, which merge across cells. Positives come first, then the windows they give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, table, written_once

ANCHORS, CANDIDATES, CELL_TILES, BUCKETS = 2048, 1024, 16, 16
#: Recursion ends where a side is at most so long.
LEAF = 16
MOST_TASKS = 20_000
_NONE = np.iinfo(np.int64).min
TILE = "bucket int, number long, width int, ids binary, labels binary, vectors binary, lows binary, highs binary, slots binary"


def _leaf(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """The product of whole numbers, whose every sum of products is at most `most`: in doubles where those are exact."""
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64, exactly; odd sizes are padded with zeros. Raises if a sum could leave 63 bits."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    high = top(a) * top(b) * max(1, a.shape[1])
    levels = max(0, min(int(np.ceil(np.log2(max(1, s) / LEAF))) for s in (a.shape[0], a.shape[1], b.shape[1])))
    # A level doubles entries of either factor at most; what is added up afterwards is exact modulo 2**64 anyway.
    if high * 4**levels >= 2**63:
        levels = 0
    if high >= 2**63:
        raise OverflowError("inner products of these vectors don't fit into 64 bits")

    def times(x: np.ndarray, y: np.ndarray, depth: int, most: int) -> np.ndarray:
        if not depth:
            return _leaf(x, y, most)
        n, k, m = x.shape[0], x.shape[1], y.shape[1]
        if n % 2 or k % 2:
            x = np.pad(x, ((0, n % 2), (0, k % 2)))
        if k % 2 or m % 2:
            y = np.pad(y, ((0, k % 2), (0, m % 2)))
        r, s, t = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
        x11, x12, x21, x22 = x[:r, :s], x[:r, s:], x[r:, :s], x[r:, s:]
        y11, y12, y21, y22 = y[:s, :t], y[:s, t:], y[s:, :t], y[s:, t:]
        down = lambda p, q: times(p, q, depth - 1, most * 2)
        p1, p2, p3, p4 = down(x11 + x22, y11 + y22), down(x21 + x22, y11), down(x11, y12 - y22), down(x22, y21 - y11)
        p5, p6, p7 = down(x11 + x12, y22), down(x21 - x11, y11 + y12), down(x12 - x22, y21 + y22)
        return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:n, :m]

    return times(a, b, levels, high)


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """rows whose label and vector aren't null and whose components are all finite, with floor(scale * component) as long.
    Raises on components of 2**31 / scale or more, as inner products are to fit into 64 bits."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    bounded = lambda x: F.when(F.abs(x) < float(1 << 31), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return kept.withColumn(vector, F.transform(vector, lambda x: bounded(F.lit(float(scale)) * x.cast("double"))))


def _tiles(rows: DataFrame, size: int, by_label: bool) -> DataFrame:
    """TILE of rows(id, label, vector, and for anchors slots, lows and highs): at most `size` rows in one; of a bucket of labels each
    if asked for. Vectors of a tile are padded with zeros to the longest."""
    names = rows.columns
    windows = "slots" in names

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def tile(bucket: int) -> pa.RecordBatch:
            nonlocal made
            got = held.pop(bucket)
            width = max(len(r[2]) for r in got)
            vectors = np.zeros((len(got), width), np.int32)
            for k, r in enumerate(got):
                vectors[k, : len(r[2])] = r[2]
            flat = lambda c: np.array([x for r in got for x in (r[c] if windows else ())], np.int64).tobytes()
            slots = np.array([len(r[5]) if windows else 0 for r in got], np.int64).tobytes() + (flat(5) if windows else b"")
            made += 1
            values = [[bucket], [(part << 32) + made], [width], [np.array([r[0] for r in got], np.int64).tobytes()], [np.array([r[1] for r in got], np.int64).tobytes()], [vectors.tobytes()], [flat(3) if windows else b""], [flat(4) if windows else b""], [slots]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [f.split()[0] for f in TILE.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                bucket = row[1] % BUCKETS if by_label else 0
                held.setdefault(bucket, []).append(row)
                if len(held[bucket]) == size:
                    yield tile(bucket)
        for bucket in sorted(held):
            yield tile(bucket)

    return rows.mapInArrow(run, TILE)


def _best(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of scores with columns that fit: the n best scores and their ids, of equal scores the smaller ids."""
    some = np.flatnonzero(fits.any(axis=1))
    masked, n = np.where(fits[some], scores[some], _NONE), min(n, fits.shape[1])
    # What reaches the n-th best score is at least n columns, or more on ties.
    least = np.partition(masked, masked.shape[1] - n, axis=1)[:, masked.shape[1] - n]
    for k, row, reach in zip(some, masked, least):
        at = np.flatnonzero(row >= max(reach, _NONE + 1))
        at = at[np.lexsort((ids[at], -row[at]))[:n]]
        yield int(k), row[at], ids[at]


def _merged(old: tuple | None, scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps of at most n as one."""
    if old is not None:
        scores, ids = np.append(old[0], scores), np.append(old[1], ids)
        order = np.lexsort((ids, -scores))[:n]
        scores, ids = scores[order], ids[order]
    return scores, ids


def _cells(anchors: DataFrame, candidates: DataFrame, n_candidates: int, keep: Callable, slots: int, n: int) -> DataFrame:
    """(anchor_id, slot, id, score): the n best of what `keep` lets through, for each anchor and slot and each cell. A cell is an
    anchor tile and about CELL_TILES candidate tiles of its bucket, which come one by one behind it.

    Anchor tiles are few (a row for ANCHORS anchors), and their numbers are joined to the candidate tiles of their bucket; a bucket
    of many candidates has many cells, so a hot label is split.
    """
    spark = anchors.sparkSession
    shares = max(-(-n_candidates // (CANDIDATES * CELL_TILES)), min(spark.sparkContext.defaultParallelism, -(-n_candidates // 64)), 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, anchors.count() * shares // 4))
    first = anchors.withColumn("tile", F.col("number")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    named = anchors.select("bucket", F.col("number").alias("tile")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    turned = candidates.withColumn("turn", F.pmod(F.col("number") + F.shiftright("number", 32), F.lit(shares)).cast("int"))
    met = turned.join(named, ["bucket", "turn"]).withColumn("kind", F.lit(1)).withColumn("share", F.col("turn"))
    columns = ["tile", "share", "kind", *[f.split()[0] for f in TILE.split(", ")]]

    def run(batches):
        at, heaps, mine, bar = None, {}, None, None

        def emit() -> pa.RecordBatch:
            rows = [(int(mine["ids"][a]), slot, int(i), int(s)) for (a, slot), (scores, ids) in heaps.items() for s, i in zip(scores, ids)]
            parts = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in parts], ["anchor_id", "slot", "id", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in columns}
                now = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "lows", "highs", "slots")}
                now["vectors"] = np.frombuffer(row["vectors"], np.int32).reshape(len(now["ids"]), row["width"]).astype(np.int64)
                if not row["kind"]:
                    if mine is not None:
                        yield emit()
                    at, heaps, mine = (row["tile"], row["share"]), {}, now
                    bar = np.full((len(now["ids"]), slots + 1), _NONE)  # what a full heap's last score is
                    continue
                if (row["tile"], row["share"]) != at:
                    raise ValueError("a tile came without its anchors")
                width = max(mine["vectors"].shape[1], row["width"])
                wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
                scores = strassen(wide(mine["vectors"]), wide(now["vectors"]).T)
                for slot, which, fits in keep(mine, now, scores):
                    fits &= scores[which] >= bar[which, slot][:, None]
                    for a, s, i in _best(scores[which], now["ids"], fits, n):
                        key = (int(which[a]), int(slot[a]))
                        heaps[key] = _merged(heaps.get(key), s, i, n)
                        if len(heaps[key][0]) == n:
                            bar[key] = heaps[key][0][-1]
        if mine is not None:
            yield emit()

    # A tile of anchors, and each tile of candidates, is a row of its own batch: they are some hundred kB.
    laid = first.select(*columns).unionByName(met.select(*columns)).repartition(tasks, "tile", "share").sortWithinPartitions("tile", "share", "kind")
    return laid.mapInArrow(run, "anchor_id long, slot long, id long, score long")


def _first(rows: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= n)


def _alike(mine: dict, now: dict, scores: np.ndarray):
    same = (mine["labels"][:, None] == now["labels"][None]) & (mine["ids"][:, None] != now["ids"][None])
    every = np.arange(len(mine["ids"]))
    yield np.zeros(len(every), np.int64), every, same


def _window(low: int, high: int, scale: int) -> Callable:
    def keep(mine: dict, now: dict, scores: np.ndarray):
        n = len(mine["ids"])
        counts = mine["slots"][:n]
        starts = np.append(0, np.cumsum(counts))[:-1]
        other = mine["labels"][:, None] != now["labels"][None]
        for k in range(int(counts.max(initial=0))):
            which = np.flatnonzero(counts > k)
            at, s = starts[which] + k, scores[which] * scale
            yield mine["slots"][n:][at], which, other[which] & (mine["lows"][at][:, None] <= s) & (s <= mine["highs"][at][:, None])

    return keep


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(id, label, vector) and anchors, some of
    them: an anchor's positives are its best other rows of the same label, and a positive's negatives the best rows of other labels
    with low * its score <= scale * theirs <= high * its score. Scores are inner products; of equal ones the smaller id is better.

    vector: array<long> below 2**31, of which missing components count as 0; label: long; neither is null. Of
    anchors equal in id the least counts; of repeated rows each does, but an anchor's own id is none of its positives. An anchor without positives, or a positive without rows in its window, has no
    rows; negative scores have none, as their window is empty. An empty table gives an empty one.
    """
    rows = rows.select("id", "label", "vector")
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.label", "least.vector")
    n, tiles = rows.count(), _kept(rows, CANDIDATES, True)
    met = _cells(_kept(anchors, ANCHORS, True), tiles, n, _alike, 0, positives)
    best = cut(_first(met, ["anchor_id"], positives, "slot").select("anchor_id", F.col("slot").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    spans = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))  # `positives` at most
    asked = anchors.join(spans, anchors["id"] == spans["anchor_id"]).select("id", "label", "vector", F.transform("p", lambda x: x["positive_score"] * low).alias("lows"), F.transform("p", lambda x: x["positive_score"] * high).alias("highs"), F.col("p.slot").alias("slots"))
    found = _first(_cells(_kept(asked, ANCHORS, False), tiles.withColumn("bucket", F.lit(0)), n, _window(low, high, scale), positives, negatives), ["anchor_id", "slot"], negatives, "rank")
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _kept(rows: DataFrame, size: int, by_label: bool) -> DataFrame:
    """Tiles, written once: what numbers a tile is its place in a task, which must not change when a task runs again."""
    return written_once(_tiles(rows, size, by_label), "tiles")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    turned = given.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = whole_vectors(turned).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM v),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 10
"""
