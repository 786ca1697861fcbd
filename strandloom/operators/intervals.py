"""Joins on half-open intervals and bands.

Catalyst plans an interval predicate as a nested loop, so both sides are dealt into bins and meet by (chrom, level, bin);
adaptive execution splits hot bins. Bins have levels, each FACTOR times as wide. An interval's own level is the finest at
which it touches at most SPREAD bins, so a very long one is few rows; a pair meets at the coarser of its two levels, in
the first bin that it shares there: rows visit, beside their own, the coarser levels that the other side has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .names import free

FACTOR, SPREAD, LEVELS = 16, 4, 8
#: Rows of equal span that are one list, or about as many.
LISTED = 1024


def _level(start: Column, end: Column, width: int) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        w = width * FACTOR**k
        out = F.when(F.floor((end - 1) / w) - F.floor(start / w) < SPREAD, F.lit(k)).otherwise(out)
    return out


def _levels(df: DataFrame, start: str, end: str, width: int) -> list[int]:
    return sorted(r[0] for r in df.select(_level(F.col(start), F.greatest(end, F.col(start) + 1), width).alias("l")).distinct().collect())  # at most LEVELS rows


def _dealt(df: DataFrame, start: str, end: str, width: int, mine: list[int], others: list[int], own_in: list[int], visits_in: int, name: list[str]) -> DataFrame:
    """A row for each (level, bin, side) that an interval takes part in; at the own level, one of mine, on the sides own_in."""
    level, bin_, side = name
    stop = F.greatest(F.col(end), F.col(start) + 1)
    visits = [x for x in others if x > min(mine, default=0)]
    if len(mine) == 1 and not visits and len(own_in) == 1:
        wide = width * FACTOR ** mine[0]
        return df.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor((stop - 1) / wide)))).withColumns({level: F.lit(mine[0]), side: F.lit(own_in[0])})
    own = _level(F.col(start), stop, width)
    seats = F.concat(F.array(*[F.struct(own.alias("level"), F.lit(s).alias("side")) for s in own_in]), F.filter(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(visits_in).alias("side")) for x in visits]), lambda x: x["level"] > own) if visits else F.expr("cast(array() as array<struct<level:int,side:int>>)"))
    wide = F.lit(width) * F.pow(F.lit(FACTOR), F.col(f"{side}.level")).cast("long")
    seated = df.withColumn(side, F.explode(seats)).withColumn(bin_, F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor((stop - 1) / wide))))
    return seated.withColumn(level, F.col(f"{side}.level")).withColumn(side, F.col(f"{side}.side"))


def _met(left: DataFrame, right: DataFrame, width: int, levels: tuple[list[int], list[int]], tasks: int | None = None) -> DataFrame:
    """Pairs of overlap_join, of sides whose levels are known; in that many tasks, if it is said."""
    names = free(left.join(right, F.lit(False)), "level", "bin", "side", "level_b", "bin_b", "side_b")
    # Side 1 holds pairs at the left one's own level, side 2, where any may be, those at a coarser level of the right one.
    coarser = any(x > min(levels[0], default=0) for x in levels[1])
    left = _dealt(left, "start", "end", width, levels[0], levels[1], [1], 2, names[:3])
    right = _dealt(right, "b_start", "b_end", width, levels[1], levels[0], [1, 2] if coarser else [1], 1, names[3:])
    if tasks:
        left = left.repartition(tasks, "chrom", *names[:3]).sortWithinPartitions("chrom", *names[:3], "start", "end")  # neighbours meet the same rows
    met = left.join(right, (F.col("chrom") == F.col("b_chrom")) & (F.col(names[0]) == F.col(names[3])) & (F.col(names[1]) == F.col(names[4])) & (F.col(names[2]) == F.col(names[5])))
    once = F.col(names[1]) == F.floor(F.greatest("start", "b_start") / (F.lit(width) * F.pow(F.lit(FACTOR), F.col(names[0])).cast("long")))
    return met.where((F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")) & once).drop(*names)


def _known(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.where(F.col("start").isNotNull() & F.col("end").isNotNull()), b.where(F.col("b_start").isNotNull() & F.col("b_end").isNotNull())


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of a(chrom, start, end, ...) and b(b_chrom, b_start, b_end, ...) with start < b_end and end > b_start.

    width: of the finest bins, near the usual length. Rows with a null chrom, start or end meet none."""
    left, right = _known(a, b)
    return _met(left, right, width, (_levels(left, "start", "end", width), _levels(right, "b_start", "b_end", width)))


def _listed(rows: DataFrame, span: list[str], name: str) -> DataFrame:
    """A row for each span, with an array of what else its rows hold; a span of more than LISTED rows has several."""
    n, share = free(rows, "n", "share")
    rest = [F.col(x) for x in rows.columns if x not in span] or [F.lit(True).alias(n)]
    many = rows.groupBy(*span).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > LISTED)
    # Equal rows of a partition stay together, those of several are dealt as well; a task that is run again deals as before.
    dealt = rows.join(many, span, "left").withColumn(share, F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce(F.ceil(F.col(n) / LISTED), F.lit(1))))
    return dealt.groupBy(*span, share).agg(F.collect_list(F.struct(*rest)).alias(name)).drop(share)


def _tasks(df: DataFrame) -> int:
    """Tasks for a join whose rows are many more than what is shuffled, by which adaptive execution would choose too few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def overlap_pairs(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The pairs of overlap_join for tables in which spans recur: lists of rows of equal span meet, and are laid out as pairs only then.

    So what is shuffled and compared follows both tables, not their pairs, and the pairs of two lists stand together, where a
    column of one side is a run and that of the other the same list again, so that files hold little more than the lists."""
    left, right = _known(a, b)
    levels = _levels(left, "start", "end", width), _levels(right, "b_start", "b_end", width)
    x, y = free(a.join(b, F.lit(False)), "x", "y")
    met = _met(_listed(left, ["chrom", "start", "end"], x), _listed(right, ["b_chrom", "b_start", "b_end"], y), width, levels, _tasks(a))
    every = met.withColumn(y, F.explode(y)).withColumn(x, F.explode(x))
    side = lambda rows, span, at: [F.col(c) if c in span else F.col(f"{at}.{c}").alias(c) for c in rows.columns]
    return every.select(*side(a, ("chrom", "start", "end"), x), *side(b, ("b_chrom", "b_start", "b_end"), y))


def _hit(a: DataFrame, b: DataFrame, width: int) -> tuple[DataFrame, str]:
    """a with a column of whether each row overlaps any of b, whatever its other values: equal rows are equal in this, too."""
    spot, c, s, e = free(a, "hit", "hit_chrom", "hit_start", "hit_end")
    spans = a.select("chrom", "start", "end").distinct()
    hit = overlap_join(spans, b.select("b_chrom", "b_start", "b_end").distinct(), width).select(F.col("chrom").alias(c), F.col("start").alias(s), F.col("end").alias(e)).distinct().withColumn(spot, F.lit(True))
    return a.join(hit, (F.col("chrom") == F.col(c)) & (F.col("start") == F.col(s)) & (F.col("end") == F.col(e)), "left").drop(c, s, e), spot


def overlap_semi(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Rows of a that overlap any of b."""
    met, hit = _hit(a, b, width)
    return met.where(F.col(hit).isNotNull()).drop(hit)


def overlap_anti(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Rows of a that overlap none of b; those with a null chrom, start or end overlap none."""
    met, hit = _hit(a, b, width)
    return met.where(F.col(hit).isNull()).drop(hit)


def _back(a: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a with the columns of found(chrom, start, end, ...) for their span; those that aren't in it go."""
    c, s, e = free(a.join(found.drop("chrom", "start", "end"), F.lit(False)), "f_chrom", "f_start", "f_end")
    renamed = found.withColumnsRenamed({"chrom": c, "start": s, "end": e})
    return a.join(renamed, (F.col("chrom") == F.col(c)) & (F.col("start") == F.col(s)) & (F.col("end") == F.col(e))).drop(c, s, e)


def first_overlap(a: DataFrame, b: DataFrame, key: list[str], width: int, label: str = "label") -> DataFrame:
    """One row of b for each row of a that overlaps any: the one that begins first, then ends first, then by label.

    Equal spans of a have the same answer, and of equal spans of b only the least label can be one, so each meets once."""
    (m,) = free(a, "m")
    least = b.groupBy("b_chrom", "b_start", "b_end").agg(F.min(F.struct(F.col(label).alias(label))).alias("b_label"))
    met = overlap_join(a.select("chrom", "start", "end").distinct(), least, width)
    found = met.groupBy("chrom", "start", "end").agg(F.min(F.struct("b_start", "b_end", F.col(f"b_label.{label}").alias(label))).alias(m))
    return _back(a.select(*dict.fromkeys([*key, "chrom", "start", "end"])), found).groupBy(*key).agg(F.min(m).alias(m)).select(*key, f"{m}.*")


def weighted_mean(a: DataFrame, b: DataFrame, key: list[str], width: int, score: str = "score") -> DataFrame:
    """(key, mean_score): mean of b's score over the bases of a that it covers, 0 if none. A record that starts at 0 doesn't count, and its first base
    doesn't. Other columns of a, and of b but for its span and score, don't matter. Equal spans meet once: of a they have the same sums, and those of b
    are brought to one with the sum of their scores."""
    a = a.select(*dict.fromkeys([*key, "chrom", "start", "end"]))
    scored = b.where("b_start <> 0").groupBy("b_chrom", "b_start", "b_end").agg(F.sum(F.col(score)).alias("b_score"), F.count(F.lit(1)).alias("b_rows"))
    bases = F.greatest(F.lit(0), F.least("b_end", "end") - F.greatest(F.col("b_start") + 1, F.col("start")) + 1)
    met = overlap_join(a.select("chrom", "start", "end").distinct(), scored, width)
    found = met.groupBy("chrom", "start", "end").agg(F.sum(bases * F.col("b_score")).alias("b_x"), F.sum(bases * F.col("b_rows")).alias("b_n"))
    sums = _back(a, found).groupBy(*key).agg(F.sum("b_x").alias("b_x"), F.sum("b_n").alias("b_n"))
    return a.join(sums, key, "left").select(*key, F.coalesce(F.try_divide(F.col("b_x"), F.col("b_n")), F.lit(0.0)).alias("mean_score"))


def annotate(a: DataFrame, b: DataFrame, key: list[str], width: int, text: str = "label", missing: str = "NA") -> DataFrame:
    """Every row of a with the distinct texts of b that it overlaps, sorted and joined by `;`. A column of a named annotation is replaced; null texts don't count.
    Equal spans of a, and equal spans of b with the same text, meet once."""
    a = a.drop("annotation")
    spans, texts = a.select(*dict.fromkeys([*key, "chrom", "start", "end"])), b.select("b_chrom", "b_start", "b_end", F.col(text).alias("b_text")).distinct()
    met = overlap_join(spans.select("chrom", "start", "end").distinct(), texts, width).groupBy("chrom", "start", "end").agg(F.collect_set("b_text").alias("b_texts"))
    every = _back(spans, met).select(*key, F.explode("b_texts").alias("b_text"))
    found = every.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("b_text")), ";").alias("annotation"))
    return a.join(found, key, "left").withColumn("annotation", F.coalesce("annotation", F.lit(missing)))


def band_pairs(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs of left(chrom, pos, ...) and right(r_chrom, r_pos, ...) at most `distance` apart; each right row visits three bins."""
    bin_l, bin_r = free(left.join(right, F.lit(False)), "bin_l", "bin_r")
    l = left.withColumn(bin_l, F.floor(F.col("pos") / (distance + 1)))
    r = right.withColumn(bin_r, F.explode(F.array(*[F.floor(F.col("r_pos") / (distance + 1)) + k for k in (-1, 0, 1)])))
    met = l.join(r, (F.col("chrom") == F.col("r_chrom")) & (F.col(bin_l) == F.col(bin_r)))
    return met.where(F.abs(F.col("pos") - F.col("r_pos")) <= distance).drop(bin_l, bin_r)


def decluster(rows: DataFrame, value: str, distance: int, block: int = 1 << 20) -> DataFrame:
    """Rows of (chrom, pos, value, ...) without a strictly larger value within `distance`; ties keep both.

    A range window holds the largest value of the neighbourhood, so no pairs arise; rows near a block's edge visit the next block, too."""
    b, own, most, seat = free(rows, "block", "own", "most", "seat")
    seats = F.transform(F.sequence(F.floor((F.col("pos") - distance) / block), F.floor((F.col("pos") + distance) / block)), lambda x: F.struct(x.alias(b), (x == F.floor(F.col("pos") / block)).alias(own)))
    dealt = rows.withColumn(seat, F.explode(seats)).select(*rows.columns, f"{seat}.*")
    near = W.partitionBy("chrom", b).orderBy("pos").rangeBetween(-distance, distance)
    return dealt.withColumn(most, F.max(value).over(near)).where(F.col(own) & (F.col(value) >= F.col(most))).drop(b, own, most)


def _cover(start: np.ndarray, end: np.ndarray, value: np.ndarray, size: int, least) -> list[np.ndarray]:
    """Tables of the largest value over stretches of 2**k points, of spans [start, end) of points below size."""
    deep = max(1, size.bit_length())
    power = np.frexp((end - start).astype(float))[1] - 1  # the largest k with 2**k <= length
    tables = [np.full(size, least, value.dtype) for _ in range(deep)]
    for k in range(deep - 1, -1, -1):
        if k + 1 < deep:
            np.maximum(tables[k], tables[k + 1], out=tables[k])
            np.maximum(tables[k][1 << k :], tables[k + 1][: size - (1 << k)], out=tables[k][1 << k :])
        mine = np.flatnonzero(power == k)
        np.maximum.at(tables[k], start[mine], value[mine])
        np.maximum.at(tables[k], end[mine] - (1 << k), value[mine])
    # Pushed down, the last table holds each point's own largest value; from it those of stretches are built.
    out = [tables[0]]
    for k in range(1, deep):
        half, wide = 1 << (k - 1), out[-1].copy()
        np.maximum(wide[:-half], out[-1][half:], out=wide[:-half])
        out.append(wide)
    return out


def decluster_spans(rows: DataFrame, value: str, reach: int, width: int = 1 << 14) -> DataFrame:
    """Rows of (chrom, start, end, value, ...) that no row of strictly larger value overlaps within [start - reach, end + reach); ties keep both.

    Positions are whole numbers, no span ends before it begins, and reach is 1 at least. No pairs arise: spans are cut at blocks of `width` positions (at least
    1024), a block's largest value at each point is a table, and a span looks up the largest one of its stretch. Of equal spans only the largest value takes part,
    and only one row for each span and value is looked up."""
    if reach < 1:
        raise ValueError("reach must be 1 or more")
    width = max(width, 1024)
    c, s, e, v = free(rows, "c_chrom", "c_start", "c_end", "c_value")
    kind = {f.name: f.dataType for f in rows.schema}[value]
    whole = isinstance(kind, T.IntegralType)
    known = rows.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(value).cast("long" if whole else "double").alias("v")).where("chrom is not null and start is not null and end >= start and v is not null")
    distinct = known.distinct()
    peak = known.groupBy("chrom", "start", "end").agg(F.max("v").alias("v")).select("chrom", "start", "end", "v", F.lit(False).alias("asked"))
    asked = distinct.select("chrom", (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"), "v", F.lit(True).alias("asked"))
    # Twice as many points as positions: a span that is empty is the even point at its place, which others hold only inside.
    both = peak.unionByName(asked).withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))))
    size, least = 2 * width, np.iinfo(np.int64).min if whole else -np.inf

    def look(key, table):
        start, end, val, ask = (table.column(n).to_numpy() for n in ("start", "end", "v", "asked"))
        first = key[1].as_py() * size
        low = np.maximum(np.where(end > start, 2 * start + 1, 2 * start) - first, 0)
        high = np.minimum(np.where(end > start, 2 * end, 2 * start + 1) - first, size)
        tables = np.stack(_cover(low[~ask], high[~ask], val[~ask], size, least))
        q = np.flatnonzero(ask)
        power = np.frexp((high[q] - low[q]).astype(float))[1] - 1
        best = np.maximum(tables[power, low[q]], tables[power, high[q] - (1 << power)])
        return table.take(pa.array(q[best > val[q]])).select(["chrom", "start", "end", "v"])

    beaten = both.groupBy("chrom", "b").applyInArrow(look, f"chrom {dict(rows.dtypes)['chrom']}, start long, end long, v {'long' if whole else 'double'}").select(F.col("chrom").alias(c), (F.col("start") + reach).alias(s), (F.col("end") - reach).alias(e), F.col("v").alias(v)).distinct()
    return rows.join(beaten, (F.col("chrom") == F.col(c)) & (F.col("start") == F.col(s)) & (F.col("end") == F.col(e)) & (F.col(value) == F.col(v)), "left_anti")


def prefer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key by a total order. A rank within each key and random share comes first, so that a hot key is not one task."""
    share, rank = free(rows, "share", "rank")
    dealt = rows.withColumn(share, F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    best = dealt.withColumn(rank, F.row_number().over(W.partitionBy(*keys, share).orderBy(*order))).where(F.col(rank) == 1).drop(rank, share)
    return best.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def replace_ids(rows: DataFrame, ids: DataFrame, uuid: str, width: int) -> DataFrame:
    """rows(chrom, start, end, uuid, ...) with the uuid of each of ids(b_chrom, b_start, b_end, b_uuid) that they overlap: a row for each, none for others.

    Ids of equal span meet as lists, and are laid out only then."""
    left, right = _known(rows.drop(uuid), ids.select("b_chrom", "b_start", "b_end", "b_uuid"))
    (y,) = free(rows, "y")
    met = _met(left, _listed(right, ["b_chrom", "b_start", "b_end"], y), width, (_levels(left, "start", "end", width), _levels(right, "b_start", "b_end", width)), _tasks(rows))
    return met.withColumn(y, F.explode(y)).withColumn(uuid, F.col(f"{y}.b_uuid")).select(*rows.columns)
