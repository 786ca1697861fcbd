"""Insertions that may be chimeras of an element of the genome: what a consensus shares with both its element and its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consensus import ungapped_best
from .intervals import overlap_semi
from .lineage import cut
from .names import free

#: Score from which an alignment counts, and bases around a call in which an element of the genome is looked for.
LEAST_SCORE, AROUND = 100, 10_000


def _best(rows: DataFrame, target: str, out: str) -> DataFrame:
    """(UUID, out) of rows(UUID, q, target): struct of start, end on q itself, and the identity in percent, of its best ungapped alignment."""
    size = F.length("q")
    start, end = (F.when(F.col("strand") == "-", size - F.col(f"query_{b}")).otherwise(F.col(f"query_{a}")) for a, b in (("start", "end"), ("end", "start")))
    pairs = rows.select("UUID", "q", F.upper(target).alias("t")).where((F.length("q") > 0) & (F.length("t") > 0))
    return ungapped_best(pairs, "q", "t", 0.0).where(F.col("score") >= LEAST_SCORE).select("UUID", F.struct(start.alias("start"), end.alias("end"), (100 * F.col("identity")).alias("identity")).alias(out))


def _given(x: str) -> Column:
    return F.nullif(F.upper(x), F.lit("NA"))


def homology(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """(UUID, ChimeraBaseCount, ChimeraMatchIns, ChimeraMatchRef, InsSiteHomology) of calls(UUID, element, ref_seq, Genomic_Consensus_3p, Genomic_Consensus_5p): the stretch of the
    3' consensus (of the 5' one where that is NA or null) that aligns to its element and to its site alike, and how well that stretch
    by itself aligns to each, in percent; 0 and NA without one. elements(element, element_seq). Ids are unique; spans are on the consensus
    as it is given, whichever strand aligns; an unknown element aligns to nothing."""
    # Kept, as both alignments and the join of both read them.
    rows = cut(calls.join(elements.select("element", "element_seq"), "element", "left").select("UUID", "element_seq", "ref_seq", F.coalesce(_given("Genomic_Consensus_3p"), _given("Genomic_Consensus_5p")).alias("q")))
    met = rows.join(_best(rows, "element_seq", "i"), "UUID", "left").join(_best(rows, "ref_seq", "g"), "UUID", "left")
    start, end = F.greatest("i.start", "g.start"), F.least("i.end", "g.end")
    shared = F.when(F.col("i").isNotNull() & F.col("g").isNotNull() & (end > start), F.substring("q", (start + 1).cast("int"), (end - start).cast("int")))
    parts = cut(met.select("UUID", "element_seq", "ref_seq", shared.alias("q")))  # read three times
    again = parts.join(_best(parts, "element_seq", "i"), "UUID", "left").join(_best(parts, "ref_seq", "g"), "UUID", "left")
    identity = lambda x: F.coalesce(F.col(f"{x}.identity"), F.lit(0.0))
    return again.select("UUID", F.coalesce(F.length("q"), F.lit(0)).alias("ChimeraBaseCount"), identity("i").alias("ChimeraMatchIns"), identity("g").alias("ChimeraMatchRef"), F.coalesce("q", F.lit("NA")).alias("InsSiteHomology"))


def annotated(calls: DataFrame, elements: DataFrame, masks: DataFrame, width: int = 4096) -> DataFrame:
    """calls(UUID, chrom, start, end, superfamily, ...) with the columns of `homology` and PossibleRefEltChimera: whether an element of the genome of the call's superfamily lies
    within AROUND bases, or none of the superfamily's is known on that chromosome. masks(superfamily, chrom, start, end); superfamilies without any have none.
    superfamily may list several, by commas. Calls without a superfamily or element (null or NA) are left out."""
    known = calls.where((F.coalesce("superfamily", F.lit("NA")) != "NA") & (F.coalesce("element", F.lit("NA")) != "NA"))
    fam, near = free(known, "family", "near")
    each = known.select("UUID", F.explode(F.split("superfamily", ",")).alias(fam), F.col("chrom"), F.greatest(F.col("start") - AROUND, F.lit(0)).alias("start"), (F.col("end") + AROUND).alias("end"))
    # A family's own chromosome, so that one join serves all families.
    place = lambda f: F.concat_ws("|", f, "chrom")
    spans = masks.select(place("superfamily").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    asked = each.select("UUID", fam, place(fam).alias("chrom"), "start", "end")
    hit = overlap_semi(asked, spans, width).select("UUID")
    bare = asked.join(masks.select(F.col("superfamily").alias(fam)).distinct(), fam, "left_semi").join(spans.select(F.col("b_chrom").alias("chrom")).distinct(), "chrom", "left_anti").select("UUID")
    flagged = hit.union(bare).distinct().withColumn(near, F.lit(True))
    return known.join(homology(known, elements), "UUID").join(flagged, "UUID", "left").withColumn("PossibleRefEltChimera", F.coalesce(near, F.lit(False))).drop(near)
