"""Sequence functions as column expressions. Positions are 0-based and half-open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cigar import let

# IUPAC codes and their complements.
CODES, COMPLEMENTS = "acgtrymkbdhvACGTRYMKBDHV", "tgcayrkmvhdbTGCAYRKMVHDB"


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, CODES, COMPLEMENTS))


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def poly_a_fraction(s: Column) -> Column:
    """The larger share of A or T in either case; 0 for null or empty."""
    return F.coalesce(F.try_divide(F.greatest(count_of(F.upper(s), "A"), count_of(F.upper(s), "T")).cast("double"), F.length(s)), F.lit(0.0))


def only_poly_a(s: Column) -> Column:
    """Whether more than 95 % of an alignment's letters are A, or are T; case counts."""
    return F.coalesce(F.greatest(count_of(s, "A"), count_of(s, "T")).cast("double") / F.nullif(F.length(s), F.lit(0)) > 0.95, F.lit(False))


def run_scan(s: Column, letter: str) -> Column:
    """struct(start, run) of the first longest run of the letter, whatever its case; run is its length less one; (0, 0) if none."""
    runs = F.regexp_extract_all(F.upper(s), F.lit(f"({letter}+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.when(longest > 0, F.struct((F.instr(F.upper(s), F.repeat(F.lit(letter), longest)) - 1).alias("start"), (longest - 1).alias("run"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("run")))


def common_walk(a: Column, b: Column, most: int = 100) -> Column:
    """How many of the first letters of both are the same, `most` at most."""
    n = F.least(F.length(a), F.length(b), F.lit(most))
    other = F.array_position(F.zip_with(F.split(F.substring(F.upper(a), F.lit(1), n), ""), F.split(F.substring(F.upper(b), F.lit(1), n), ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(n == 0, 0).when(other > 0, (other - 1).cast("int")).otherwise(n)


def target_site(left_of: Column, right_of: Column, left_seq: Column, right_seq: Column, most: int = 100) -> Column:
    """Bases by which a junction can be moved to both sides: the walk on, and the walk back, together at most 2 * most."""
    return common_walk(left_of, right_of, most) + common_walk(F.reverse(left_seq), F.reverse(right_seq), most)


def longest_try(tries: Column) -> Column:
    """The longest of an array of strings, the earliest on ties; null if the array is empty."""
    most = F.array_max(F.transform(tries, F.length))
    return F.try_element_at(F.filter(tries, lambda x: F.length(x) == most), F.lit(1))


def widest_gap(blocks: Column) -> Column:
    """struct(start, end) of the widest gap between sorted blocks(start, end), the first on ties; null for fewer than two."""
    gaps = F.zip_with(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    most = F.array_max(F.transform(gaps, lambda g: g["end"] - g["start"]))
    return F.try_element_at(F.filter(gaps, lambda g: g["end"] - g["start"] == most), F.lit(1))


def psl_scores() -> dict[str, Column]:
    """score, span and pctmatch of PSL columns, by the formulas of that format's own tools for nucleotides."""
    m, x, r, q, t = (F.col(n) for n in ("matches", "mismatches", "repmatches", "qnuminsert", "tnuminsert"))
    aligned = m + r + x
    size = F.least(F.col("qend") - F.col("qstart"), F.col("tend") - F.col("tstart"))
    off = F.greatest(F.col("qend") - F.col("qstart") - (F.col("tend") - F.col("tstart")), F.lit(0))
    bad = 1000.0 * (x + q + F.round(3 * F.log(1.0 + off))) / F.nullif(aligned, F.lit(0))
    return {"score": m + F.shiftright(r, 1) - x - q - t, "span": F.col("tend") - F.col("tstart"), "pctmatch": F.when(size <= 0, 0.0).otherwise(100.0 - bad * 0.1)}


def uncovered(length: Column, spans: Column) -> Column:
    """array of struct(start, end), half-open: what sorted or unsorted spans(start, end) leave uncovered of [0, length)."""
    fold = F.aggregate(
        F.array_sort(spans),
        F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>))"),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"].cast("int")).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].cast("int").alias("end"))))).otherwise(acc["out"]).alias("out")),
    )
    tail = F.when(fold["at"] < length, F.array(F.struct(fold["at"].alias("start"), length.cast("int").alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    return F.concat(fold["out"], tail)


def tail_strand(s: Column, n: int = 20) -> Column:
    """+ if the sequence has n A in a row, - if n T, the first of these; else null."""
    return F.when(F.contains(F.upper(s), F.lit("A" * n)), "+").when(F.contains(F.upper(s), F.lit("T" * n)), "-")


def with_tail(s: Column, n: int = 50) -> Column:
    """A transcript with its tail of A."""
    return F.concat(s, F.lit("A" * n))


def cigar_match(cigar: Column, nm: Column) -> Column:
    """1 - NM over the M bases of a CIGAR; -1 without NM or such bases."""
    m = F.aggregate(F.regexp_extract_all(cigar, F.lit("([0-9]+)M"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    return F.coalesce(1 - F.try_divide(nm.cast("double"), m), F.lit(-1.0))


def longest_run(s: Column, letter: str) -> Column:
    """Length of the longest run of the letter, whatever its case; 0 if none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.upper(s), F.lit(f"({letter}+)"), F.lit(1)), F.length)), F.lit(0))


def match_fraction(a: Column, b: Column) -> Column:
    """Share of equal columns of an alignment of two strings of equal length, case aside."""
    same = F.size(F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    return F.try_divide(same.cast("double"), F.length(a))


def locate_first(long: Column, short: Column) -> Column:
    """struct(start, end) of the first occurrence, null if none; an empty short string is at [0, 0]."""
    at = F.instr(long, short) - 1
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(short)).alias("end")))


def locate_last(long: Column, short: Column) -> Column:
    """The same of the last of the occurrences found from the left that don't overlap: of `aa` in `aaa`, [0, 2]."""
    rest = F.element_at(F.split(long, F.concat(F.lit("\\Q"), short, F.lit("\\E")), -1), -1)
    at = F.length(long) - F.length(rest) - F.length(short)
    return F.when(F.length(short) == 0, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).when(F.contains(long, short), F.struct(at.alias("start"), (at + F.length(short)).alias("end")))


def oriented(long: Column, short: Column) -> Column:
    """short as it stands in long, or its reverse complement if that does; else null."""
    return F.when(F.contains(long, short), short).when(F.contains(long, reverse_complement(short)), reverse_complement(short))


def quality_trim_at(values: Column, window: int = 4, least: float = 5.0) -> Column:
    """First index at which the mean of `window` qualities falls below `least`; null if none does. The last window is not looked at."""

    def at(v: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(v) - window - 1), lambda i: F.aggregate(F.slice(v, i + 1, F.lit(window)), F.lit(0.0), lambda a, x: a + x) / window < least)
        # A mean is no less than the least of its values, so most have no window that must be looked at.
        return F.when((F.size(v) > window) & (F.array_min(v) < least), F.try_element_at(spots, F.lit(1)))

    return let(values, at)  # computed once, not for each window


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def swap_strand(s: Column) -> Column:
    return F.when(s.isin("+", "-"), F.translate(s, "+-", "-+"))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared bases of two half-open intervals; 0 if none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def signed_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Between intervals with inclusive ends: negative when they overlap."""
    return F.greatest(s1, s2) - F.least(e1, e2)


def touches_end(spans: Column, length: Column, tolerance: int = 2) -> Column:
    """Whether any (start, end) lies within tolerance of either end of a sequence."""
    return F.exists(spans, lambda s: (s["start"] <= tolerance) | (s["end"] >= length - tolerance))


def pair_score(left: Column, right: Column, overlap: Column, n_left: Column, n_right: Column, shape: float = 2.5, scale: float = 3.0) -> Column:
    """Gamma density of the overlap times its square, less the distance that it leaves unexplained, plus support."""
    gamma = 1.3293403881791370  # of 2.5
    density = F.pow(overlap, F.lit(shape - 1)) * F.exp(-overlap / F.lit(scale)) / F.lit(gamma * scale**shape)
    apart = F.abs(left - right).cast("double")
    penalty = F.when(overlap > 0, F.abs(apart - overlap)).otherwise(apart)
    return density * overlap * overlap - penalty + n_left + n_right


def dose(vaf: Column) -> Column:
    return 2.0 - 2.0 * vaf


def genotype(depth: Column, vaf: Column, least: int = 10, low: float = 0.15) -> Column:
    d = dose(vaf)
    return F.when(depth < least, "./.").when((d > 2 * low) & (d < 2 * (1 - low)), "0/1").when(d < 2 * low, "0/0").otherwise("1/1")


def normal_tail(z: Column, sides: int = 2) -> Column:
    """The probability that a normal variable is farther out than |z| (sides 1: beyond it), by the complementary error function's rational
    approximation with a relative error below 1.2e-7 everywhere."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # The approximation's coefficients, from the highest power down.
    series = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = series * t + F.lit(a)
    return F.lit(sides / 2) * t * F.exp(-x * x + series)


def one_against_all_p(lower: Column, equal: Column, n: Column, sides: int = 2) -> Column:
    """The exact p of a rank-sum test of one value against n others without ties: `lower` of them lie below it. Each rank is as likely as another. With
    equal ones among them it is null, as the exact distribution doesn't hold."""
    out = F.least(F.lit(1.0), sides * (F.least(lower, n - lower) + 1) / (n + 1))
    return F.when((equal == 0) & (n > 0), out)
