"""Clustering along an ordered axis: gaps, islands, windows and folds.

A chromosome is far too long for one task, so rows are ordered within blocks of positions, a block's total is one row,
and only those rows are ordered by chromosome; what lies before a block is added to its rows (`stitched`). Folds that no
window expresses stream over sorted partitions, within stretches that no cluster can cross.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .lineage import cut
from .names import free

BLOCK = 1 << 20


def stitched(rows: DataFrame, key: str, order: list[str], value: Column, how: str, out: str, block: int = BLOCK) -> DataFrame:
    """rows with a value over the rows of the same key up to it in `order`, whose first column is a position: "sum" of all
    with the row's own, "max" of those before it, or "lag", that of the row before. block: positions ordered in one task.
    rows are computed once and checkpointed, as blocks' totals and the rows themselves both need them."""
    b, v, t, k2, b2 = free(rows, "block", "value", "total", "key_of_block", "number_of_block")
    dealt = cut(rows.withColumns({b: F.floor(F.col(order[0]) / block), v: value}))
    inner, blocks = W.partitionBy(key, b).orderBy(*order), W.partitionBy(key).orderBy(b)
    total = {"sum": F.sum(v), "max": F.max(v), "lag": F.max_by(v, F.struct(*order))}[how]
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)
    before = {"sum": F.coalesce(F.sum(t).over(earlier), F.lit(0)), "max": F.max(t).over(earlier), "lag": F.lag(t).over(blocks)}[how]
    totals = dealt.groupBy(key, b).agg(total.alias(t)).select(F.col(key).alias(k2), F.col(b).alias(b2), before.alias(t))
    met = dealt.join(totals, F.col(key).eqNullSafe(F.col(k2)) & F.col(b).eqNullSafe(F.col(b2)))
    rows_before = inner.rowsBetween(W.unboundedPreceding, -1)
    done = {"sum": F.sum(v).over(inner.rowsBetween(W.unboundedPreceding, 0)) + F.col(t), "max": F.greatest(F.max(v).over(rows_before), F.col(t)), "lag": F.coalesce(F.lag(v).over(inner), F.col(t))}[how]
    return met.withColumn(out, done).select(*[c for c in rows.columns if c != out], out)


def running(rows: DataFrame, keys: list[str], at: str, values: list[str], block: int = 1 << 14) -> DataFrame:
    """(keys, at, values): sums over all rows of the same keys up to each position `at`, one row for each. Blocks of positions are summed by themselves, and a
    block's totals are one row; nulls count as 0."""
    b, b2, *names = free(rows, "block", "number_of_block", *[f"before_{i}" for i in range(len(values))], *[f"key_{i}" for i in range(len(keys))])
    before, other = names[: len(values)], names[len(values) :]
    summed = rows.groupBy(*keys, at).agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(v) for v in values])
    dealt = cut(summed.withColumn(b, F.floor(F.col(at) / block)))
    earlier = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, b).agg(*[F.sum(v).alias(v) for v in values])
    known = totals.select(*[F.col(k).alias(o) for k, o in zip(keys, other)], F.col(b).alias(b2), *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(n) for v, n in zip(values, before)])
    same = F.col(b) == F.col(b2)
    for k, o in zip(keys, other):
        same &= F.col(k).eqNullSafe(F.col(o))
    inner = W.partitionBy(*keys, b).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return dealt.join(known, same).select(*keys, at, *[(F.sum(v).over(inner) + F.col(n)).alias(v) for v, n in zip(values, before)])


def gap_chain(rows: DataFrame, key: str, start: str, end: str, spacing: int, tie: str, out: str = "chain", block: int = BLOCK) -> DataFrame:
    """A number for each chain: a row joins if it starts at most `spacing` after the row before it ended. Rows equal in start
    and tie should end alike; of those, the one that begins a chain counts as the first."""
    b, n, new, inner, k2, b2, base = free(rows, "block", "number", "new", "inner", "key_of_block", "number_of_block", "base")
    first_start, last_end, size, opens = free(rows, "first_start", "last_end", "size", "opens")
    # Within a block all but its first row know their place; one row a block says how its first row and its numbers go on.
    order = W.partitionBy(key, b).orderBy(start, tie)
    joins = F.col(start) - F.lag(end).over(order) <= spacing
    placed = rows.withColumn(b, F.floor(F.col(start) / block)).withColumns({n: F.row_number().over(order), new: F.when(joins, 0).otherwise(1)}).withColumn(new, F.when(F.col(n) == 1, 0).otherwise(F.col(new)))
    dealt = cut(placed.withColumn(inner, F.sum(new).over(order.rowsBetween(W.unboundedPreceding, 0))))
    blocks = W.partitionBy(key).orderBy(b)
    totals = dealt.groupBy(key, b).agg(F.min_by(start, n).alias(first_start), F.max_by(end, n).alias(last_end), F.max(inner).alias(size))
    opened = totals.withColumn(opens, F.when(F.col(first_start) - F.lag(last_end).over(blocks) <= spacing, 0).otherwise(1))
    earlier = F.coalesce(F.sum(F.col(size) + F.col(opens)).over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = opened.select(F.col(key).alias(k2), F.col(b).alias(b2), (earlier + F.col(opens)).alias(base))
    met = dealt.join(known, F.col(key).eqNullSafe(F.col(k2)) & F.col(b).eqNullSafe(F.col(b2)))
    return met.withColumn(out, F.col(base) + F.col(inner)).select(*[c for c in rows.columns if c != out], out)


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """fold over the rows (keys, then order, as a stream of tuples) of sorted partitions, in which each key is whole."""
    names = [f.name for f in T._parse_datatype_string(schema)]
    kinds = T._parse_datatype_string(schema)

    def run(batches):
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[tuple] = []
        for row in fold(stream):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], arrow)
                held = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)
    # A fixed number of tasks: a fold costs far more than its bytes, by which small partitions would be put together.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *order).repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def median_cluster(rows: DataFrame, key: str, pos: str, distance: int, own: str | None = None) -> DataFrame:
    """(key, first, last, n): sorted positions, a new cluster where one is farther than `distance` from the middle member.

    own: a column that stands for the middle of a cluster of one row (a read's own median position) instead of its position.
    A gap wider than the distance begins a cluster, so the fold runs within chains of closer rows (own ones counted too).
    """
    chain, reach, one = free(rows, "chain", "reach", "own")
    held = rows.select(key, F.col(pos).cast("long").alias(pos), F.col(own or pos).cast("long").alias(one))
    far = held.withColumn(reach, F.greatest(pos, one))
    chained = gap_chain(far, key, pos, reach, distance, one, chain)
    kind = dict(rows.dtypes)[key]

    def fold(stream):
        now, at, middle = [], None, None
        for k, c, p, o in stream:
            if at != (k, c) or abs((now[len(now) // 2] if len(now) > 1 else middle) - p) > distance:
                if at:
                    yield at[0], now[0], now[-1], len(now)
                now, at, middle = [], (k, c), o
            now.append(p)
        if at:
            yield at[0], now[0], now[-1], len(now)

    return sorted_fold(chained, [key, chain], [pos, one], f"`{key}` {kind}, first long, last long, n long", fold)


def islands(depths: DataFrame, key: str, pos: str, depth: str, least: int, length: int) -> DataFrame:
    """(key, start, end): runs of consecutive positions of which all but the first must be deeper than `least`, whose
    last position lies `length` or more behind the first. A shallow position begins a run of its own; end is exclusive."""
    before, new, run = free(depths, "before", "new", "run")
    lagged = stitched(depths, key, [pos], F.col(pos), "lag", before)
    marked = lagged.withColumn(new, F.when((F.col(pos) == F.col(before) + 1) & (F.col(depth) > least), 0).otherwise(1))
    runs = stitched(marked, key, [pos], F.col(new), "sum", run).groupBy(key, run).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    return runs.where(F.col("end") - 1 - F.col("start") >= length).drop(run)


def depth_runs(reads: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, depth): stretches of equal depth over half-open spans, those of depth 0 left out."""
    step, total = free(reads, "step", "depth")
    events = reads.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias(step)), F.struct(F.col(end).alias("at"), F.lit(-1).alias(step)))).alias("e")).select(key, "e.*")
    steps = events.groupBy(key, "at").agg(F.sum(step).alias(step)).where(F.col(step) != 0)
    summed = stitched(steps, key, ["at"], F.col(step), "sum", total)
    # The next change, as the row before in falling order.
    turned = stitched(summed.withColumn("back", -F.col("at")), key, ["back"], F.col("at"), "lag", "until")
    return turned.where(F.col(total) > 0).select(key, F.col("at").alias("start"), F.col("until").alias("end"), F.col(total).alias("depth"))


def even_windows(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Rows with the number of their window of `size` rows within the key."""
    (rank,) = free(rows, "rank")
    ranked = stitched(rows, key, order, F.lit(1), "sum", rank)
    return ranked.withColumn("window", F.floor((F.col(rank) - 1) / size).cast("long")).drop(rank)


def bins(contigs: DataFrame, name: str, length: str, width: int) -> DataFrame:
    """(name, start, end) of the fixed bins of each contig."""
    size, at = free(contigs, "size", "start")
    begun = contigs.where(F.col(length) > 0).select(name, F.col(length).alias(size), F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1, F.lit(width).cast("long"))).alias(at))
    return begun.select(name, F.col(at).alias("start"), F.least(F.col(at) + width, F.col(size)).alias("end"))


def chunks(contigs: DataFrame, name: str, length: str, n: int, pad: int = 0) -> DataFrame:
    """(chunk, name, start, end): the contigs laid end to end by name and cut into n pieces of equal length, each widened by pad within its contig.

    contigs holds one row for each contig, so the unpartitioned running sum is over a short list.
    """
    to, begin = free(contigs, "to", "begin")
    ends = contigs.withColumn(to, F.sum(length).over(W.orderBy(name).rowsBetween(W.unboundedPreceding, 0)))
    total = contigs.agg(F.sum(length)).first()[0] or 1
    piece = -(-total // n)
    laid = ends.withColumn(begin, F.col(to) - F.col(length)).where(F.col(length) > 0)
    met = laid.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(begin) / piece), F.floor((F.col(to) - 1) / piece))))
    start, end = F.greatest(F.col(begin), F.col("chunk") * piece) - F.col(begin), F.least(F.col(to), (F.col("chunk") + 1) * piece) - F.col(begin)
    return met.select("chunk", name, F.greatest(start - pad, F.lit(0)).alias("start"), F.least(end + pad, F.col(length)).alias("end"))


def sweep_longest(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, start, end, size) in order of start: of two that overlap, the larger stays, the earlier on ties.

    The sweep holds one row, so it breaks wherever a row starts after all before it ended; each such stretch is folded.
    """
    reach, new, stretch = free(rows, "reach", "new", "stretch")
    order = ["start", "end", "size"]
    swept = stitched(rows.select(key, *[F.col(c).cast("long").alias(c) for c in order]), key, order, F.col("end"), "max", reach)
    swept = stitched(swept.withColumn(new, F.when(F.col("start") < F.col(reach), 0).otherwise(1)), key, order, F.col(new), "sum", stretch)

    def fold(stream):
        last = at = None
        for k, c, start, end, size in stream:
            if at == (k, c) and start < last[1] and end > last[0]:
                last = (start, end, size) if size > last[2] else last
                continue
            if last:
                yield at[0], *last
            last, at = (start, end, size), (k, c)
        if last:
            yield at[0], *last

    return sorted_fold(swept, [key, stretch], order, f"`{key}` {dict(rows.dtypes)[key]}, start long, end long, size long", fold)


def strand_of(rows: DataFrame, keys: list[str], order: list[str], own: str, mate: str) -> DataFrame:
    """(keys, strand): "-" if the first and last member's strands both equal their mates', "+" if both differ, else NA."""
    ends = rows.groupBy(*keys).agg(F.min_by(F.col(own) == F.col(mate), F.struct(*order)).alias("a"), F.max_by(F.col(own) == F.col(mate), F.struct(*order)).alias("z"))
    return ends.select(*keys, F.when(F.col("a") & F.col("z"), "-").when(~F.col("a") & ~F.col("z"), "+").otherwise("NA").alias("strand"))


def strand_switch(rows: DataFrame, keys: list[str], order: list[str], strand: str, other: str) -> DataFrame:
    """(keys, switches, together): whether each of two strand columns changes exactly once, and both at the same member.

    The first member that differs from the head lies just after the last one that differs from the tail only then."""
    place = F.struct(*order)
    marked = rows.select(*keys, place.alias("p"), F.col(strand).alias("s"), F.col(other).alias("o"))
    head = marked.groupBy(*keys).agg(F.min_by("s", "p").alias("s0"), F.min_by("o", "p").alias("o0"))
    met = marked.join(head, keys)
    seen = met.groupBy(*keys).agg(*[f.alias(n) for n, f in {
        "s_first": F.min(F.when(F.col("s") != F.col("s0"), F.col("p"))), "s_last": F.max(F.when(F.col("s") == F.col("s0"), F.col("p"))),
        "o_first": F.min(F.when(F.col("o") != F.col("o0"), F.col("p"))), "o_last": F.max(F.when(F.col("o") == F.col("o0"), F.col("p"))),
    }.items()])
    once = (F.col("s_first") > F.col("s_last")) & (F.col("o_first") > F.col("o_last"))
    return seen.select(*keys, F.coalesce(once, F.lit(False)).alias("switches"), F.coalesce(once & (F.col("s_first") == F.col("o_first")), F.lit(False)).alias("together"))
