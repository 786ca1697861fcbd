"""Grouped evidence: counts, support, masks and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .names import free


def allele_counts(rows: DataFrame, keys: list[str], is_alt: Column) -> DataFrame:
    """(keys, alt, ref, vaf)."""
    counted = rows.groupBy(*keys).agg(F.count_if(is_alt).alias("alt"), F.count_if(~is_alt).alias("ref"))
    return counted.withColumn("vaf", F.coalesce(F.try_divide(F.col("alt").cast("double"), F.col("alt") + F.col("ref")), F.lit(0.0)))


def counted_set(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """`value|count` entries of each key, sorted and joined by commas, and how many values there are. Counts meet before lists do."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("|", F.col(value).cast("string"), F.col("n").cast("string"))
    return counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias(out), F.count(F.lit(1)).alias(f"n_{out}"), F.max("n").alias(f"max_{out}"))


def mode_with_share(rows: DataFrame, keys: list[str], value: str, least: int, share: float) -> DataFrame:
    """The most common value (smallest on ties) of keys with at least `least` rows, where it has that share."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("t"), F.sum("n").alias("total"))
    return top.where((F.col("total") >= least) & (-F.col("t.m") >= share * F.col("total"))).select(*keys, F.col("t.v").alias(value), (-F.col("t.m")).alias("n"), "total")


def zscore_mask(counts: DataFrame, group: str | None, value: str, above: float) -> DataFrame:
    """Rows whose population z-score within the group (over all rows if there is none) exceeds `above`. Statistics meet as one row for each group."""
    mean, sd = free(counts, "mean", "sd")
    stats = (counts.groupBy(group) if group else counts.groupBy()).agg(F.avg(value).alias(mean), F.stddev_pop(value).alias(sd))
    z = F.try_divide(F.col(value) - F.col(mean), F.col(sd))
    met = counts.join(stats, group) if group else counts.join(F.broadcast(stats))  # one row
    return met.withColumn("z", z).where(F.col("z") > above).drop(mean, sd)


def cpm_mask(reads: DataFrame, bins: DataFrame, width: int, mapped: Column, counted: Column, above: float = 2.0) -> DataFrame:
    """(chrom, start, end, cpm, z) of bins(chrom, start, end) of fixed width whose counts per million mapped reads and base lie more than `above` deviations over the mean of all bins.

    reads(chrom, pos) count in the bin of their position if they are `counted`; bins without reads count as 0, and so do all where no read is mapped."""
    (million,) = free(bins, "million")
    total = reads.agg((F.count_if(mapped).cast("double") / 1e6).alias(million))  # one row
    n = reads.where(counted).groupBy("chrom", (F.floor(F.col("pos") / width) * width).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    cpm = F.coalesce(F.try_divide(F.coalesce(F.col("n"), F.lit(0)), F.col(million)) / (F.col("end") - F.col("start")), F.lit(0.0))
    return zscore_mask(bins.join(n, ["chrom", "start"], "left").join(F.broadcast(total)).select("chrom", "start", "end", cpm.alias("cpm")), None, "cpm", above)


def reasons(tests: dict[str, Column], passed: str = "PASS") -> Column:
    """The names of all tests that hold, joined by commas, else `passed`."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return F.when(F.size(found) == 0, F.lit(passed)).otherwise(F.array_join(found, ","))


def first_reason(tests: dict[str, Column]) -> Column:
    """The first test that holds, else null."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests.items()], F.lit(None).cast("string"))


def swap_columns(rows: DataFrame, pairs: list[tuple[str, str]], flip: Column) -> DataFrame:
    """rows with both columns of each pair swapped where flip holds."""
    return rows.withColumns({x: F.when(flip, F.col(y)).otherwise(F.col(x)) for a, b in pairs for x, y in ((a, b), (b, a))})


def depth_cap(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of keys that have at most `most` rows."""
    (n,) = free(rows, "n")
    dense = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > most)
    return rows.join(dense.select(*keys), keys, "left_anti")


def density_cap(rows: DataFrame, chunks: DataFrame, key: str, start: str, end: str, samples: int, density: float = 2.0, most: int = 1000) -> DataFrame:
    """rows(key, ...) of chunks(key, start, end) that aren't too dense: more than density * samples rows a base, or, in
    chunks no longer than `most`, more than most * density rows."""
    (n,) = free(rows, "n")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).join(chunks.select(key, (F.col(end) - F.col(start)).alias("span")), key)
    dense = counts.where(F.when(F.col("span") <= most, F.col(n) > most * density).otherwise(F.col(n) > F.col("span") * (density * samples)))
    return rows.join(dense.select(key), key, "left_anti")


def sample_cap(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key, the first by a total order: a sampling operator."""
    share, rank = free(rows, "share", "rank")
    first = rows.withColumn(share, F.pmod(F.xxhash64(*rows.columns), F.lit(64))).withColumn(rank, F.row_number().over(W.partitionBy(*keys, share).orderBy(*order))).where(F.col(rank) <= most)
    return first.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most).drop(share, rank)


def proportional_cap(rows: DataFrame, keys: list[str], kind: str, order: list[Column], most: int = 50) -> DataFrame:
    """All rows of keys with at most `most`; of others, each kind keeps the whole part of its share of `most`, its first by a total order."""
    n, all_, rank = free(rows, "n", "all_rows", "rank")
    kinds = rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias(n))
    share = kinds.join(kinds.groupBy(*keys).agg(F.sum(n).alias(all_)), keys)
    met = rows.join(share, [*keys, kind])
    ranked = met.withColumn(rank, F.row_number().over(W.partitionBy(*keys, kind).orderBy(*order)))
    return ranked.where((F.col(all_) <= most) | (F.col(rank) <= F.floor(F.col(n) / F.col(all_) * most))).select(*rows.columns)


def hash_sample(rows: DataFrame, keys: list[str], by: list[str], most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows of each key, those whose seeded hash is lowest: a seeded sample that any partitioning repeats."""
    return sample_cap(rows, keys, [F.xxhash64(F.lit(seed), *by), *[F.col(c) for c in by]], most)


def rank_sum(rows: DataFrame, group: str, value: str, is_first: Column) -> DataFrame:
    """(group, n1, n2, u): the Mann-Whitney statistic of the rows that satisfy is_first, with mid-ranks for ties.

    Ranks come from counts of distinct values, so a window sees one row for each of them.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_first).alias("n1"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("r", before + (F.col("n") + 1) / 2.0)
    out = ranked.groupBy(group).agg(F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"), F.sum(F.col("n1") * F.col("r")).alias("w"))
    return out.select(group, "n1", "n2", (F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"))
