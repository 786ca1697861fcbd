"""Where the bases of an aligned read lie: walks over a CIGAR as column expressions.

A walk is as long as its CIGAR has operations; it is a fold, so a CIGAR of many thousand operations costs their square.
Positions are 0-based; a null CIGAR or position gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<op:string,n:int,query:int,ref:bigint>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def walk(cigar: Column, pos: Column) -> Column:
    """array of struct(op, n, query, ref): each operation with the base of the read and the position at which it begins."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))

    def step(acc: Column, part: Column) -> Column:
        op, n = F.right(part, F.lit(1)), F.regexp_replace(part, "[A-Z=]", "").cast("int")
        here = F.struct(op.alias("op"), n.alias("n"), acc["query"].alias("query"), acc["ref"].alias("ref"))
        return F.struct((acc["query"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("query"), (acc["ref"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("ref"), F.concat(acc["steps"], F.array(here)).alias("steps"))

    zero = F.struct(F.lit(0).alias("query"), pos.cast("long").alias("ref"), F.expr(f"cast(array() as array<{STEP}>)").alias("steps"))
    return F.when(cigar.isNotNull() & pos.isNotNull(), F.aggregate(parts, zero, step, lambda acc: acc["steps"]))


def matched(steps: Column) -> Column:
    """The operations of a walk that set bases against positions."""
    return F.filter(steps, lambda s: s["op"].isin("M", "=", "X"))


def aligned_span(steps: Column) -> Column:
    """struct(first, last) of the positions that bases stand against; null if none does."""
    m = matched(steps)
    return F.when(F.size(m) > 0, F.struct(F.get(m, F.lit(0))["ref"].alias("first"), F.transform(F.slice(m, -1, F.lit(1)), lambda s: s["ref"] + s["n"] - 1)[0].alias("last")))


def covers(steps: Column, at: Column) -> Column:
    """Whether a base stands against the position; a deletion or skip doesn't."""
    return F.exists(matched(steps), lambda s: (s["ref"] <= at) & (at < s["ref"] + s["n"]))


def query_at(steps: Column, at: Column) -> Column:
    """The base of the read that stands against the position; null if none does."""
    found = F.filter(matched(steps), lambda s: (s["ref"] <= at) & (at < s["ref"] + s["n"]))
    return F.get(F.transform(found, lambda s: (s["query"] + at - s["ref"]).cast("int")), F.lit(0))


def bases_over(seq: Column, steps: Column, start: Column, end: Column) -> Column:
    """The read's letters that stand against the positions [start, end), those of deletions left out, inserted ones too."""

    def part(s: Column) -> Column:
        low, high = F.greatest(start, s["ref"]), F.least(end, s["ref"] + s["n"])
        return F.when(low < high, F.substring(seq, (s["query"] + low - s["ref"] + 1).cast("int"), (high - low).cast("int"))).otherwise("")

    return F.array_join(F.transform(matched(steps), part), "")


def counted_bases(seq: Column, steps: Column, start: Column, end: Column) -> Column:
    """The same where positions are counted through: the k-th position with a base has the k-th letter behind the leading clip. Without
    insertions both agree."""
    lead = F.coalesce(F.get(F.transform(F.filter(F.slice(steps, 1, F.lit(2)), lambda s: s["op"] == "S"), lambda s: s["query"] + s["n"]), F.lit(0)), F.lit(0))
    first = F.when(F.get(steps, F.lit(0))["op"].isin("S", "H"), lead).otherwise(0)

    def part(acc: Column, s: Column) -> Column:
        low, high = F.greatest(start, s["ref"]), F.least(end, s["ref"] + s["n"])
        here = F.when(low < high, F.substring(seq, (first + acc["k"] + low - s["ref"] + 1).cast("int"), (high - low).cast("int"))).otherwise("")
        return F.struct((acc["k"] + s["n"]).alias("k"), F.concat(acc["out"], here).alias("out"))

    return F.when(steps.isNotNull(), F.aggregate(matched(steps), F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), part, lambda acc: acc["out"]))


def aligned_pairs(seq: Column, steps: Column) -> Column:
    """array of struct(ref, query, base) of all bases that stand against a position."""
    one = lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.struct((s["ref"] + i).alias("ref"), (s["query"] + i).alias("query"), F.substring(seq, s["query"] + i + 1, F.lit(1)).alias("base")))
    return F.flatten(F.transform(F.filter(matched(steps), lambda s: s["n"] > 0), one))


def target_site(one: Column, two: Column, exact: bool = False) -> Column:
    """struct(start, end, first, second): the positions that both junctions' alignments cover, half-open, and each one's letters over them; null
    unless they share two positions or more. one, two: structs of pos, cigar and seq, null if an end has no alignment. exact: letters
    by the walk, else as counted through (see counted_bases)."""
    letters = bases_over if exact else counted_bases

    def of_walks(w: Column) -> Column:
        return let(F.struct(aligned_span(w["a"]).alias("a"), aligned_span(w["b"]).alias("b")), lambda s: let(F.struct(F.greatest(s["a"]["first"], s["b"]["first"]).alias("start"), F.least(s["a"]["last"], s["b"]["last"]).alias("end")), lambda g: site(w, s, g)))

    def site(w: Column, s: Column, g: Column) -> Column:
        stop = g["end"] + 1
        out = F.struct(g["start"].alias("start"), stop.alias("end"), letters(one["seq"], w["a"], g["start"], stop).alias("first"), letters(two["seq"], w["b"], g["start"], stop).alias("second"))
        return F.when(s["a"].isNotNull() & s["b"].isNotNull() & (g["end"] - g["start"] > 0), out)

    return let(F.struct(walk(one["cigar"], one["pos"]).alias("a"), walk(two["cigar"], two["pos"]).alias("b")), of_walks)
