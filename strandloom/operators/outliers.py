"""Isolation forests: rows that few random cuts set apart are outliers of their family."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evidence import hash_sample

#: Trees, rows that each learns from, and rows of a family that trees draw from (the bound of what reaches the driver).
TREES, TREE_ROWS, FAMILY_ROWS = 100, 256, 2048


def usual_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> np.ndarray:
    """A tree as rows of (column, cut, left, right, own): a leaf's column is -1, and its own depth that of the rows it would still take."""
    nodes: list[list[float]] = []

    def add(x: np.ndarray, depth: int) -> int:
        at, spread = len(nodes), np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
        nodes.append([-1, 0, at, at, usual_path(len(x))])
        if depth and len(x) > 1 and spread.any():
            column = int(rng.choice(np.flatnonzero(spread)))
            cut = rng.uniform(x[:, column].min(), x[:, column].max())
            low = x[:, column] < cut
            nodes[at] = [column, cut, add(x[low], depth - 1), add(x[~low], depth - 1), 1.0]
        return at

    add(x, depth)
    return np.array(nodes)


def path(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, total = np.zeros(len(x), int), np.zeros(len(x))
    while True:
        column = tree[at, 0].astype(int)
        inner = column >= 0
        if not inner.any():
            return total + tree[at, 4]
        low = x[np.arange(len(x)), np.maximum(column, 0)] < tree[at, 1]
        total += inner
        at = np.where(low, tree[at, 2], tree[at, 3]).astype(int)


def laid(tree: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, cut, path) of a tree as a whole one, in which node k's children are 2k + 1 and 2k + 2; path is that of each of the lowest places."""
    column, cut, total = np.zeros(2**depth - 1, np.intp), np.zeros(2**depth - 1), np.zeros(2**depth)
    nodes = [(0, 0, 0.0)]
    while nodes:
        k, at, cuts = nodes.pop()
        inner, low, high = tree[at, 0] >= 0, int(tree[at, 2]), int(tree[at, 3])
        if k >= len(column):
            total[k - len(column)] = cuts + tree[at, 4]
            continue
        if inner:
            column[k], cut[k] = int(tree[at, 0]), tree[at, 1]
        nodes += [(2 * k + 1, low, cuts + inner), (2 * k + 2, high, cuts + inner)]
    return column, cut, total


def mean_path(forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, most: int = 1 << 13) -> np.ndarray:
    """Of each row over all trees of laid: what path gives, on average. Rows go down all trees `most` at a time."""
    out = np.zeros(len(x))
    for a in range(0, len(x), most):
        part = x[a : a + most]
        flat, rows, total = np.ascontiguousarray(part).ravel(), np.arange(len(part)) * x.shape[1], out[a : a + most]
        for column, cut, paths in forest:
            at = np.zeros(len(part), np.intp)
            for _ in range(len(paths).bit_length() - 1):
                low = flat.take(rows + column.take(at)) < cut.take(at)
                at = 2 * at + 2 - low
            total += paths.take(at - len(column))
    return out / len(forest)


def isolation(rows: DataFrame, family: str, features: list[str], trained: str | None = None, threshold: float = 0.6, seed: int = 1) -> DataFrame:
    """rows with outlier_score (0 to 1) and outlier; null features count as 0. trained: a boolean column of rows to learn from.

    A tree needs few rows by design, so each family's trees are grown in the driver from a seeded hash sample of
    FAMILY_ROWS of it; they are broadcast, and rows are scored where they are. Families (some dozens) aren't groups of tasks."""
    usable = rows.where(F.col(trained)) if trained else rows
    values = [F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f) for f in features]
    sample = hash_sample(usable.select(family, *values), [family], features, FAMILY_ROWS, seed).toPandas()
    forests = {}
    for name, part in sample.groupby(family, dropna=False):
        x, rng = part[features].sort_values(features).to_numpy(float), np.random.default_rng(seed)
        size = min(TREE_ROWS, len(x))
        depth = math.ceil(math.log2(max(size, 2)))
        forests[name if name == name else None] = size, [laid(grow(x[rng.choice(len(x), size, replace=False)], rng, depth), depth) for _ in range(TREES)]
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches):
        for batch in batches:
            x = np.stack([np.nan_to_num(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False)) for f in features], 1)
            names, score = batch.column(family).dictionary_encode(null_encoding="encode"), np.full(batch.num_rows, 0.5)
            codes = names.indices.to_numpy()
            for code, name in enumerate(names.dictionary.to_pylist()):
                size, trees = shared.value.get(name, (0, []))
                mine = np.flatnonzero(codes == code)
                if len(mine) and size > 1:
                    score[mine] = 2.0 ** (-mean_path(trees, x[mine]) / usual_path(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold)], [*batch.schema.names, "outlier_score", "outlier"])

    base = rows.drop("outlier_score", "outlier")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("outlier_score", T.DoubleType()), T.StructField("outlier", T.BooleanType())]))
