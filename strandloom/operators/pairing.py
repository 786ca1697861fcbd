"""Greedy one-to-one matching of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import sorted_fold, stitched
from .names import free


def greedy_pairs(pairs: DataFrame, groups: list[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs by falling score (then left, right), each taken if neither end is used. Groups are stretches that no pair
    crosses, such as gap chains; a task holds the ids used in the stretch at hand, not its pairs. Pairs without a score are none."""
    (falling,) = free(pairs, "falling")
    kinds = dict(pairs.dtypes)

    def take(stream):
        at, lefts, rights, n = None, set(), set(), len(groups)
        for row in stream:
            if row[:n] != at:
                at, lefts, rights = row[:n], set(), set()
            down, l, r = row[n:]
            if l not in lefts and r not in rights:
                lefts.add(l), rights.add(r)
                yield *at, l, r, -down

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*groups, left, right, score])
    return sorted_fold(pairs.where(F.col(score).isNotNull()).withColumn(falling, -F.col(score)), groups, [falling, left, right], schema, take)


def with_leftovers(taken: DataFrame, lefts: DataFrame, rights: DataFrame, left: str, right: str) -> DataFrame:
    """taken(left, right, ...) and a row for each of lefts(left) and rights(right) without a partner, whose other columns are null."""
    alone = lefts.select(left).distinct().join(taken.select(left), left, "left_anti"), rights.select(right).distinct().join(taken.select(right), right, "left_anti")
    return taken.unionByName(alone[0], allowMissingColumns=True).unionByName(alone[1], allowMissingColumns=True)


def resolved_duplicates(calls: DataFrame, order: str) -> DataFrame:
    """calls(chrom, be1, be2, sr, dr, order, ...) of which those that stand for the same insertion are one: the list is gone through in `order`, a call takes the place of
    the one that is known at its be1 if it is preferred, and calls known nowhere any more go.

    Preferred: two different breakpoints against equal ones, or more split reads, or more discordant reads. These are three ways to win, so two calls
    can each be preferred to the other, and the result depends on the order: it is a fold. Calls that share a breakpoint lie in overlapping spans, so
    the fold runs within stretches of those, as a stream that holds the calls known at their breakpoints. order is unique; calls with a null in
    these columns are left out.
    """
    start, end, reach, new, stretch = free(calls, "span_start", "span_end", "reach", "new", "stretch")
    plain = calls.dropna(subset=["chrom", "be1", "be2", "sr", "dr", order])
    spans = plain.select("chrom", order, F.col("be1").cast("long").alias("be1"), F.col("be2").cast("long").alias("be2"), F.col("sr").cast("long").alias("sr"), F.col("dr").cast("long").alias("dr")).withColumns({start: F.least("be1", "be2"), end: F.greatest("be1", "be2")})
    reached = stitched(spans, "chrom", [start, end, order], F.col(end), "max", reach)
    dealt = stitched(reached.withColumn(new, F.when(F.col(start) <= F.col(reach), 0).otherwise(1)), "chrom", [start, end, order], F.col(new), "sum", stretch)
    kinds = dict(calls.dtypes)

    def fold(stream):
        at, known = None, {}
        for chrom, where, *call in stream:
            if (chrom, where) != at:
                yield from ((at[0], c[0]) for c in set(known.values()))
                at, known = (chrom, where), {}
            call = tuple(call)
            n, one, two, sr, dr = call
            other = known.get(one)
            if other is None or (one != two and other[1] == other[2]) or sr > other[3] or dr > other[4]:
                known[one] = known[two] = call
        if at:
            yield from ((at[0], c[0]) for c in set(known.values()))

    kept = sorted_fold(dealt, ["chrom", stretch], [order, "be1", "be2", "sr", "dr"], f"chrom {kinds['chrom']}, `{order}` {kinds[order]}", fold)
    return plain.join(kept, ["chrom", order], "left_semi").select(*calls.columns)
