"""Aligned reads: what a CIGAR says, which reads are kept, where they break, and whose mates they are.

reads: bam, rg, qname, flag, chrom, pos (0-based), mapq, cigar, mate_chrom, mate_pos, seq, qual, nm, tags.
All are column expressions; only mates meet by a shuffle, on their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import aligned_pairs, let, walk
from ..functions.sequence import count_of, has_flag, normal_tail, one_against_all_p
from .names import free

# Flag bits, the tags that stay, and the distance given to ends on two chromosomes.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 64, 128, 256, 1024, 2048
TAGS = ("NM", "MD", "AS", "XS", "SA", "XA", "RG")
APART = 3_000_000_000
#: The normal quantile of the rank-sum test's least probability, 0.01.
LEAST_Z = 2.3263478740408408


def _bases(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def with_alignment(reads: DataFrame) -> DataFrame:
    """reads with ref_end, rlen (of the query), alen (on the reference), qstart and qend (of the aligned query), from the CIGAR."""
    cigar, names = F.coalesce(F.col("cigar"), F.lit("")), free(reads, "alen", "rlen", "lead", "tail")
    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).try_cast("int"), F.lit(0))
    parts = _bases(cigar, "MDN=X"), _bases(cigar, "MIS=X"), clip("^(?:[0-9]+H)?([0-9]+)S"), clip("([0-9]+)S(?:[0-9]+H)?$")
    # One row of one: filters on these columns stay behind it, so a CIGAR is read once for a row, however often they are used.
    once = reads.select("*", F.inline(F.array(F.struct(*[p.alias(n) for p, n in zip(parts, names)]))))
    alen, rlen, lead, tail = (F.col(n) for n in names)
    read = {"alen": alen, "rlen": rlen, "qstart": lead, "qend": rlen - tail, "ref_end": F.col("pos") + alen}
    return once.withColumns(read).drop(*[n for n in names if n not in read])


def sample_of(by_group: bool = False) -> Column:
    """A read's sample: its read group if asked for and there, else the file's base name."""
    name = F.element_at(F.split("bam", "/"), -1)
    return F.coalesce(F.col("rg"), name) if by_group else name


def last_base_z(qual: Column) -> Column:
    """Rank-sum statistic of all base qualities but the last against the last one: normal, corrected for ties and continuity; 0 if all are equal."""
    # Each different quality is counted once, so nothing is sorted, and equal ones aren't even told apart.
    def statistic(q: Column) -> Column:
        n, last = F.length(q).cast("double"), F.right(q, F.lit(1))
        kinds = F.transform(F.array_distinct(F.split(q, "")), lambda x: F.struct(x.alias("x"), (n - F.length(F.replace(q, x, F.lit("")))).alias("t")))

        def of_kinds(k: Column) -> Column:
            total = lambda f: F.aggregate(k, F.lit(0.0), lambda a, r: a + f(r["x"], r["t"]))
            m, ties = n - 1, total(lambda x, t: t * t * t - t)
            u = total(lambda x, t: F.when(x < last, t).when(x == last, (t - 1) / 2).otherwise(0.0))
            spread = F.sqrt((1 - ties / (n * n * n - n)) * m * (m + 2) / 12)
            return F.abs((F.greatest(u, m - u) - m / 2 - 0.5) / spread)

        return F.when((n < 2) | (F.replace(q, last, F.lit("")) == ""), 0.0).otherwise(let(kinds, of_kinds))

    return F.coalesce(let(qual, statistic), F.lit(0.0))


def last_base_p(qual: Column, sides: int = 2) -> Column:
    """The rank-sum test's p of all base qualities but the last against the last one: exact where no other quality equals the last, else by
    last_base_z; 1 if all are equal or there is one."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))

    def p_of(q: Column) -> Column:
        last, others = F.element_at(q, -1), F.slice(q, 1, F.size(q) - 1)
        count = lambda test: F.size(F.filter(others, test))
        exact = one_against_all_p(count(lambda x: x < last), count(lambda x: x == last), F.size(others), sides)
        return F.when((F.size(q) < 2) | (F.size(F.array_distinct(q)) == 1), 1.0).otherwise(F.coalesce(exact, F.least(F.lit(1.0), normal_tail(F.greatest(last_base_z(qual), F.lit(0.0)), sides))))

    return F.when(qual.isNotNull() & (F.length(qual) > 0), let(codes, p_of))


def clipped(reads: DataFrame, least: int = 3, minor: int = 2, most_n: int = 4, least_z: float = LEAST_Z) -> DataFrame:
    """Clipped reads of with_alignment(reads): mapped, no duplicate, `least` bases or more outside the alignment, of which
    the minor side has at most `minor`, few N, and a last base whose quality doesn't stand out. Masked positions go by an overlap anti join."""
    return reads.where(
        ~has_flag(F.col("flag"), UNMAPPED) & ~has_flag(F.col("flag"), DUPLICATE) & (F.col("alen") > 0) & (F.col("rlen") - F.col("alen") >= least)
        & (F.least(F.col("qstart"), F.col("rlen") - F.col("qend")) <= minor) & (count_of(F.upper("seq"), "N") <= most_n) & (last_base_z(F.col("qual")) <= least_z)
    )


def split_reads(reads: DataFrame) -> DataFrame:
    """with side, breakpos, cliplen, matchpct and the read's own median position. The longer clip is the side, the left one
    on a tie; a break on the right is at the last aligned base."""
    right = F.col("qstart") < F.col("rlen") - F.col("qend")
    return reads.withColumns({
        "side": F.when(right, "right").otherwise("left"),
        "breakpos": F.when(right, F.col("ref_end") - 1).otherwise(F.col("pos")),
        "cliplen": F.col("rlen") - (F.col("qend") - F.col("qstart")),
        "matchpct": match_fraction_of_read(),
        "middle": F.floor((F.col("pos") + F.col("ref_end") - 1) / 2),
    })


def match_fraction_of_read() -> Column:
    """1 - NM / aligned bases; null without NM."""
    return 1 - F.try_divide(F.col("nm").cast("double"), F.col("alen"))


def unclipped_start() -> Column:
    """Where a read of with_alignment would begin if its leading clip were aligned, too."""
    return F.col("pos") - F.col("qstart")


def clipped_part(seq: Column) -> Column:
    """The longer clipped side of a read's sequence, the left one on a tie."""
    return F.when(F.col("qstart") < F.col("rlen") - F.col("qend"), F.substring(seq, F.col("qend") + 1, F.length(seq))).otherwise(F.substring(seq, F.lit(1), F.col("qstart")))


def strand(bit: int = REVERSE) -> Column:
    return F.when(has_flag(F.col("flag"), bit), "-").otherwise("+")


def with_mate_span(reads: DataFrame) -> DataFrame:
    """with strand, mate_strand, mate_end (its start and this read's length) and apart, the distance of the starts."""
    apart = F.when(F.col("chrom") != F.col("mate_chrom"), F.lit(APART)).otherwise(F.abs(F.col("pos") - F.col("mate_pos")))
    return reads.withColumns({"strand": strand(), "mate_strand": strand(MATE_REVERSE), "mate_end": F.col("mate_pos") + F.length("seq"), "apart": apart})


def _far(distance: int, strictly: bool) -> Column:
    gap = F.abs(F.col("pos") - F.col("mate_pos"))
    return (F.col("chrom") != F.col("mate_chrom")) | (gap > distance if strictly else gap >= distance)


def discordant_near_site(reads: DataFrame, distance: int = 10_000) -> DataFrame:
    """Paired, mapped, primary reads with a mapping quality whose mate is unmapped, on another chromosome or farther than `distance`."""
    flag, is_ = F.col("flag"), lambda bit: has_flag(F.col("flag"), bit)
    plain = is_(PAIRED) & ~is_(UNMAPPED) & (flag.bitwiseAND(SECONDARY | SUPPLEMENTARY | DUPLICATE) == 0) & (F.col("mapq") > 0)
    return reads.where(plain & (is_(MATE_UNMAPPED) | _far(distance, True)))


def discordant(reads: DataFrame, distance: int = 10_000) -> DataFrame:
    """Of the whole genome: both ends mapped, no duplicate, a mapping quality, and `distance` or more apart."""
    return with_mate_span(reads.where((F.col("flag").bitwiseAND(UNMAPPED | MATE_UNMAPPED | DUPLICATE) == 0) & (F.col("mapq") >= 1) & _far(distance, False)))


def reduced(reads: DataFrame, distance: int = 10_000, least: int = 10, most_n: int = 4) -> DataFrame:
    """Reads that can tell of an insertion: unmapped, with an unmapped mate, soft-clipped by `least` bases, or discordant; no duplicates, hard clips or many N. Only TAGS stay."""
    is_ = lambda bit: has_flag(F.col("flag"), bit)
    soft = F.exists(F.regexp_extract_all(F.coalesce("cigar", F.lit("")), F.lit("([0-9]+)S"), F.lit(1)), lambda x: x.cast("int") >= least)
    tells = is_(UNMAPPED) | (is_(PAIRED) & is_(MATE_UNMAPPED)) | soft | (is_(PAIRED) & _far(distance, True))
    kept = reads.where(~is_(DUPLICATE) & ~F.contains(F.coalesce("cigar", F.lit("")), F.lit("H")) & (count_of(F.upper("seq"), "N") < most_n) & F.coalesce(tells, F.lit(False)))
    return kept.withColumn("tags", F.map_filter("tags", lambda k, v: k.isin(*TAGS))) if "tags" in reads.columns else kept


def mates(reads: DataFrame, wanted: DataFrame, unmapped: bool = False) -> DataFrame:
    """wanted with mate_seq and mate_mapq of the other read of the pair: same file and name, primary, the other number, at
    the mate's position; or, if asked for, the unmapped one wherever it stands."""
    flag = F.col("flag")
    plain = flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0
    b, q, one, at, chrom = free(wanted, "m_bam", "m_qname", "m_first", "m_pos", "m_chrom")
    other = reads.where(plain & (has_flag(flag, UNMAPPED) if unmapped else ~has_flag(flag, UNMAPPED))).select(F.col("bam").alias(b), F.col("qname").alias(q), has_flag(flag, READ1).alias(one), F.col("pos").alias(at), F.col("chrom").alias(chrom), F.col("seq").alias("mate_seq"), F.col("mapq").alias("mate_mapq"))
    same = (F.col("bam") == F.col(b)) & (F.col("qname") == F.col(q)) & (has_flag(flag, READ1) != F.col(one))
    if not unmapped:
        same = same & (F.col("mate_pos") == F.col(at)) & (F.col("mate_chrom") == F.col(chrom))
    return wanted.join(other, same).drop(b, q, one, at, chrom)


def pair_occupancy(reads: DataFrame) -> DataFrame:
    """(ends, n): how many names have one end here, and how many both."""
    names = reads.where(F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0).groupBy("bam", "qname").agg(F.count_distinct(has_flag(F.col("flag"), READ1)).alias("ends"))
    return names.groupBy("ends").agg(F.count(F.lit(1)).alias("n"))


def least_quality(reads: DataFrame) -> DataFrame:
    """(bam, minqual): the lowest base quality of a file, as its ASCII code, over all its reads."""
    return reads.groupBy("bam").agg(F.min(F.ascii(F.array_min(F.split("qual", "")))).alias("minqual"))


def members_of(reads: DataFrame, names: DataFrame) -> DataFrame:
    """All reads of the names (bam, qname)."""
    return reads.join(names.select("bam", "qname").distinct(), ["bam", "qname"], "left_semi")


def base_calls(reads: DataFrame, least: int = 2, share: float = 0.5, gapped: bool = False) -> DataFrame:
    """(chrom, pos, alt, n, depth): bases of reads other than the reference's, where the commonest has `least` reads and that share. A
    majority caller; the smallest base wins a tie. `ref` holds the reference's letters from a read's position on. gapped: all reads take
    part, by a walk over their CIGARs, with the bases that stand against a position; else unclipped, ungapped ones only."""
    if gapped:
        pairs = aligned_pairs(F.upper("seq"), walk(F.col("cigar"), F.col("pos")))
        each = reads.select("chrom", "pos", F.upper("ref").alias("ref"), F.explode(pairs).alias("b"))
        seen = each.select("chrom", F.col("b.ref").alias("pos"), F.col("b.base").alias("base"), F.substring("ref", (F.col("b.ref") - F.col("pos") + 1).cast("int"), F.lit(1)).alias("was"))
    else:
        plain = reads.where(F.col("cigar").rlike("^[0-9]+M$"))
        seen = plain.select("chrom", "pos", F.posexplode(F.arrays_zip(F.split(F.upper("seq"), "").alias("base"), F.split(F.upper("ref"), "").alias("was"))).alias("i", "b")).select("chrom", (F.col("pos") + F.col("i")).alias("pos"), "b.base", "b.was")
    counts = seen.groupBy("chrom", "pos", "was", "base").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"), F.min(F.struct((-F.col("n")).alias("m"), F.col("base"), F.col("was"))).alias("t"))
    return top.where((F.col("t.base") != F.col("t.was")) & (-F.col("t.m") >= least) & (-F.col("t.m") >= share * F.col("depth"))).select("chrom", "pos", F.col("t.was").alias("was"), F.col("t.base").alias("alt"), (-F.col("t.m")).alias("n"), "depth")
