"""Which way round an insertion stands: both ends' consensus sequences aligned to its element and to its site.

Only calls that passed are aligned, and only ends for which that failed are aligned again with their other consensus; the
results come back to the calls by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consensus import ungapped_best
from .evidence import swap_columns
from .lineage import cut
from .names import free

#: Score and identity from which an alignment counts, and the identity at which a site itself is like the element.
LEAST_SCORE, LEAST_IDENTITY, SELF_IDENTITY = 100, 0.9, 0.95
#: What an alignment may lose on its way, as with the aligner whose place this takes: else a run of N, or of unlike bases, is bridged wherever chance has bases meet behind it.
DROP = 30
# Columns of both ends, which change places when ends do.
BY_END = (
    ("5_Prime_End", "3_Prime_End"), ("Orient_5p", "Orient_3p"), ("5p_Elt_Match", "3p_Elt_Match"), ("5p_Genome_Match", "3p_Genome_Match"), ("Split_reads_5prime", "Split_reads_3prime"), ("5p_Cons_Len", "3p_Cons_Len"),
    ("5p_Improved", "3p_Improved"), ("TSD_5prime", "TSD_3prime"), ("Genomic_Consensus_5p", "Genomic_Consensus_3p"), ("Insert_Consensus_5p", "Insert_Consensus_3p"),
)


def _hits(rows: DataFrame, consensus: str) -> DataFrame:
    """(UUID, end, elt, gen) of rows(UUID, end, element_seq, site_seq, consensus): structs of strand, start and end on the element or site, null without an alignment."""
    kinds = F.array(F.struct(F.lit("elt").alias("kind"), F.col("element_seq").alias("t")), F.struct(F.lit("gen").alias("kind"), F.col("site_seq").alias("t")))
    pairs = rows.select("UUID", "end", F.upper(consensus).alias("q"), F.explode(kinds).alias("k")).select("UUID", "end", "q", "k.kind", F.upper("k.t").alias("t")).where((F.length("q") > 0) & (F.length("t") > 0))
    best = ungapped_best(pairs, "q", "t", LEAST_IDENTITY, DROP).where(F.col("score") >= LEAST_SCORE)
    hit = F.struct("strand", F.col("target_start").alias("start"), F.col("target_end").alias("end"))
    return best.groupBy("UUID", "end").agg(F.max(F.when(F.col("kind") == "elt", hit)).alias("elt"), F.max(F.when(F.col("kind") == "gen", hit)).alias("gen"))


def end_alignments(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """(UUID, end, elt, gen) of the 5p and 3p ends of calls(UUID, element, site_seq, Genomic_Consensus_*, Insert_Consensus_*) on elements(element, element_seq). An end whose
    genomic consensus doesn't align to both takes the insert's consensus instead, if that does. Ids are unique; an unknown element aligns to nothing."""
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"Genomic_Consensus_{e}").alias("genomic"), F.col(f"Insert_Consensus_{e}").alias("insert")) for e in ("5p", "3p")])
    # Kept, as both turns read them, and each of these its sequences twice.
    rows = cut(calls.join(elements.select("element", "element_seq"), "element", "left").select("UUID", "element_seq", "site_seq", F.explode(ends).alias("e")).select("UUID", "element_seq", "site_seq", "e.*"))
    first = cut(_hits(rows, "genomic"))  # read twice
    lacking = rows.join(first.where(F.col("elt").isNotNull() & F.col("gen").isNotNull()), ["UUID", "end"], "left_anti")
    again = _hits(lacking, "insert").where(F.col("elt").isNotNull() & F.col("gen").isNotNull())
    both = first.join(again.select("UUID", "end", F.col("elt").alias("elt2"), F.col("gen").alias("gen2")), ["UUID", "end"], "full")
    return both.select("UUID", "end", F.coalesce("elt2", "elt").alias("elt"), F.coalesce("gen2", "gen").alias("gen"))


def repaired(calls: DataFrame, elements: DataFrame, passed: Column | None = None) -> DataFrame:
    """calls with Orient_5p, Orient_3p and Inversion from their ends' alignments: + where element and site are met on the same strand, - where not, NA where
    one is not met; Inversion is Y if both are known and differ, else N. If the 5p end's stretch of the element ends behind
    the 3p end's, the ends change places (all columns of BY_END that are there). passed: other calls stay as they are."""
    chosen = calls if passed is None else calls.where(F.coalesce(passed, F.lit(False)))
    found = end_alignments(chosen, elements)
    five, three, id_ = free(calls, "five", "three", "known_id")
    met = found.groupBy(F.col("UUID").alias(id_)).agg(*[F.max(F.when(F.col("end") == e, F.struct("elt", "gen"))).alias(n) for e, n in (("5p", five), ("3p", three))])
    keep = F.lit(False) if passed is None else ~F.coalesce(passed, F.lit(False))
    joined = calls.join(met, F.col("UUID") == F.col(id_), "left")
    way = lambda x: F.coalesce(F.when(F.col(f"{x}.elt.strand") == F.col(f"{x}.gen.strand"), "+").when(F.col(f"{x}.elt.strand") != F.col(f"{x}.gen.strand"), "-"), F.lit("NA"))
    known = (way(five) != "NA") & (way(three) != "NA")
    turned = joined.withColumns({
        "Orient_5p": F.when(keep, F.col("Orient_5p")).otherwise(way(five)), "Orient_3p": F.when(keep, F.col("Orient_3p")).otherwise(way(three)),
        "Inversion": F.when(keep, F.col("Inversion")).otherwise(F.when(known & (way(five) != way(three)), "Y").otherwise("N")),
    })
    flip = ~keep & F.coalesce(F.col(f"{five}.elt.end") > F.col(f"{three}.elt.end"), F.lit(False))
    return swap_columns(turned, [p for p in BY_END if set(p) <= set(calls.columns)], flip).select(*calls.columns)


def self_aligned(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """(UUID) of calls(UUID, element, around_seq) whose own site, with what is fetched around it, is like their element: SELF_IDENTITY of the best stretch."""
    pairs = calls.join(elements.select("element", "element_seq"), "element").select("UUID", F.upper("element_seq").alias("q"), F.upper("around_seq").alias("t")).where((F.length("q") > 0) & (F.length("t") > 0))
    return ungapped_best(pairs, "q", "t", SELF_IDENTITY, DROP).where(F.col("score") >= LEAST_SCORE).select("UUID").distinct()
