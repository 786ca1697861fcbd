"""Filters of called insertions: reasons as native expressions over one row, and joins with what they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_match, longest_run
from .intervals import overlap_anti, overlap_join, weighted_mean
from .mapping import aligned

c = F.col


def prefilter(unmapped: bool = False, listed: Column | None = None, least_match: float = 0.98, least_disc: int = 4, most_fetched: int = 50, least_split: int = 4) -> Column:
    """The first reason against be1_avgmatch, be2_avgmatch, dr_count, be1_sr_count, be2_sr_count, be1_dist_seq, be2_dist_seq; null if none holds."""
    out = F.when(F.greatest(F.coalesce("be1_avgmatch", F.lit(0.0)), F.coalesce("be2_avgmatch", F.lit(0.0))) < least_match, "minmatch")
    out = out.when(c("dr_count") < min(least_disc, most_fetched), "mindisc").when(c("be1_sr_count") + F.coalesce("be2_sr_count", F.lit(0)) < least_split, "minsplit")
    if not unmapped:
        out = out.when(c("be1_dist_seq").isNull() & c("be2_dist_seq").isNull(), "mapends")
    return out.when(~F.coalesce(listed, F.lit(False)), "uuidlist") if listed is not None else out


def resolve_reasons(fetched: bool = True, least_cons: int = 250, least_prox: int = 20) -> Column:
    """array of reasons against 5_Prime_End, 3_Prime_End, the insert consensuses and lengths, be1_prox_seq and be2_prox_seq (arrays, whose joined length counts), end_flush."""
    length = lambda s: F.length(F.array_join(s, ","))
    tests = {
        "no_ends": c("5_Prime_End").isNull() & c("3_Prime_End").isNull(),
        "insert_consensus": F.lit(fetched) & c("Insert_Consensus_5p").isNull() & c("Insert_Consensus_3p").isNull(),
        "min_cons_len": c("3p_Cons_Len") + c("5p_Cons_Len") < least_cons,
        "prox_len": F.greatest(F.coalesce(length("be1_prox_seq"), F.lit(0)), F.coalesce(length("be2_prox_seq"), F.lit(0))) < least_prox,
        "end_align_flush": ~c("end_flush"),
    }
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))


#: Thresholds of the final filter; None leaves a test out.
FINAL = {"cons_len": 250, "elt_match": 0.90, "ref_match": 0.98, "disc": 4, "split": 4, "te_length": None, "vaf": None, "frac_end": None, "variants": None, "map": None, "homopolymer": 20}


def final_reasons(known: Column, limits: dict | None = None, elt_length: Column | None = None, self_aligned: Column | None = None) -> Column:
    """Reason codes of a call, joined by commas in order, else PASS.

    An unknown element is the only reason then. Sequence tests (LowMap, HomopolSite, SelfAlign) come only if nothing failed
    before; HomopolSite needs a column `site_seq`, LowMap `mappability`. A missing coordinate leaves its test out."""
    at = FINAL | (limits or {})
    top = lambda a, b: F.greatest(c(a), c(b))
    tsd5, tsd3 = F.coalesce("TSD_5prime", F.lit("NA")), F.coalesce("TSD_3prime", F.lit("NA"))
    same = lambda s: F.size(F.array_distinct(F.split(s, ""))) == 1
    tests = [
        F.when(c("Insert_Consensus_5p").isNull() & c("Insert_Consensus_3p").isNull(), "NoConsMapRef"),
        F.when(c("3p_Cons_Len") + c("5p_Cons_Len") < at["cons_len"], "TotalConsLen"),
        F.when(top("5p_Elt_Match", "3p_Elt_Match") < at["elt_match"], "MinEltMatch"),
        F.when(top("5p_Genome_Match", "3p_Genome_Match") < at["ref_match"], "MinRefMatch"),
        F.when(c("Remapped_Discordant") < at["disc"], "MinDiscord"),
        F.when(c("Split_reads_5prime") + c("Split_reads_3prime") < at["split"], "MinSplit"),
        F.when(F.levenshtein(tsd3, tsd5) > 1, "MismatchTSD").when((same(tsd5) | same(tsd3)) & (F.length(tsd3) > 10), "LongHomopolTSD"),
    ]
    if at["te_length"]:
        tests.append(F.when(c("TE_Align_End") - c("TE_Align_Start") < at["te_length"], "MinTELength"))
    if at["vaf"] is not None:
        tests += [F.when(c("max_vaf").isNull(), "MissingVAF"), F.when(F.coalesce("max_vaf", F.lit(0.0)) < at["vaf"], "MinVAF")]
    if at["frac_end"] is not None:
        tests.append(F.when(c("Genomic_Consensus_3p").isNotNull() & ((elt_length - c("TE_Align_End")) / elt_length > at["frac_end"]), "FracEnd"))
    if at["variants"] is not None:
        tests.append(F.when(F.size(F.split(F.coalesce("Variants", F.lit("NA")), ",")) > at["variants"], "MaxVars"))
    late = []
    if at["map"] is not None:
        late.append(F.when(F.coalesce("mappability", F.lit(0.0)) < at["map"], "LowMap"))
    if at["homopolymer"] is not None:
        late += [F.when(longest_run(c("site_seq"), x) - 1 > at["homopolymer"], "HomopolSite") for x in "ACGT"]
    if self_aligned is not None:
        late.append(F.when(self_aligned, "SelfAlign"))
    early, more = F.array_compact(F.array(*tests)), F.array_compact(F.array(*late)) if late else F.expr("cast(array() as array<string>)")
    written = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    return F.when(~F.coalesce(known, F.lit(False)), "UnknownInsType").otherwise(F.coalesce(written(early), written(more), F.lit("PASS")))


def with_library(calls: DataFrame, library: DataFrame) -> DataFrame:
    """calls with the length of `Superfamily:Subfamily` in library(seq_id, seq), null if it isn't there. A library is some dozens of elements."""
    lengths = library.groupBy("seq_id").agg(F.max(F.length("seq")).alias("elt_length"))
    return calls.join(lengths, F.concat_ws(":", "Superfamily", "Subfamily") == c("seq_id"), "left").drop("seq_id")


def species_filter(calls: DataFrame, rules: DataFrame, elements: DataFrame, width: int = 1024, reach: int = 0) -> DataFrame:
    """Calls that meet the rules of their superfamily and overlap (within reach) no reference element of it.

    rules(rule_family, elt_match, ref_match, disc, disc_fraction, map, least_length, most_length): a null limit holds for none;
    calls of families without a rule go by the row whose rule_family is `*`. elements(b_chrom, b_start, b_end, b_family)."""
    named = rules.where("rule_family <> '*'").select(c("rule_family").alias("has_rule"))
    keyed = calls.join(F.broadcast(named), c("Superfamily") == c("has_rule"), "left").withColumn("by_rule", F.coalesce("has_rule", F.lit("*"))).drop("has_rule")
    met = keyed.join(F.broadcast(rules), c("by_rule") == c("rule_family"))  # one row for each family
    span = c("TE_Align_End") - c("TE_Align_Start")
    bad = (
        (F.greatest("5p_Cons_Len", "3p_Cons_Len") < 120) | span.isNull() | (F.greatest("5p_Elt_Match", "3p_Elt_Match") < c("elt_match")) | (F.greatest("5p_Genome_Match", "3p_Genome_Match") < c("ref_match"))
        | (c("Remapped_Discordant") < c("disc")) | (c("Remap_Disc_Fraction") < c("disc_fraction")) | F.coalesce(c("mappability") < c("map"), F.lit(False))
        | (c("Insert_Consensus_5p").isNull() & c("Insert_Consensus_3p").isNull()) | F.coalesce(span < c("least_length"), F.lit(False)) | F.coalesce(span > c("most_length"), F.lit(False))
    )
    good = met.where(~F.coalesce(bad, F.lit(False)) & span.isNotNull()).select(*calls.columns)
    spans = good.select("UUID", "Superfamily", c("Chromosome").alias("chrom"), (c("Left_Extreme") - reach).alias("start"), (c("Right_Extreme") + reach).alias("end"))
    return good.join(overlap_join(spans, elements, width).where(c("b_family") == c("Superfamily")).select("UUID").distinct(), "UUID", "left_anti")


def gene_filter(calls: DataFrame, pseudogenes: DataFrame, genes: DataFrame, width: int = 1024, least_map: float = 0.9) -> DataFrame:
    """Calls of processed transcripts: both ends good, a target site on both that is the same, no pseudogene there, and not
    within the gene that gave the transcript (the superfamily without its last part). genes(b_chrom, b_start, b_end, gene)."""
    low, high = lambda a, b: F.least(c(a), c(b)), lambda a, b: F.greatest(c(a), c(b))
    good = (
        (high("3p_Cons_Len", "5p_Cons_Len") >= 120) & (c("TE_Align_End") - c("TE_Align_Start") >= 400) & c("TSD_3prime").eqNullSafe(c("TSD_5prime")) & (low("Split_reads_5prime", "Split_reads_3prime") >= 1)
        & (c("Remap_Disc_Fraction") >= 0.5) & (high("5p_Elt_Match", "3p_Elt_Match") >= 0.95) & (low("5p_Elt_Match", "3p_Elt_Match") >= 0.9) & (high("5p_Genome_Match", "3p_Genome_Match") >= 0.98)
        & (low("5p_Genome_Match", "3p_Genome_Match") >= 0.95) & (c("Remapped_Discordant") >= 4) & (c("mappability") >= least_map)
    )
    kept = calls.where(good).withColumns({"chrom": c("Chromosome"), "start": c("Left_Extreme"), "end": F.greatest(c("Right_Extreme"), c("Left_Extreme") + 1)})
    apart = overlap_anti(kept, pseudogenes, width)
    own = overlap_join(apart.select("UUID", "Superfamily", "chrom", "start", "end"), genes, width).where(c("gene") == F.regexp_extract("Superfamily", r"^(.*)\.[^.]*$", 1)).select("UUID").distinct()
    return apart.join(own, "UUID", "left_anti").select(*calls.columns)


def map_filter(rows: DataFrame, scores: DataFrame, key: list[str], width: int, cutoff: float = 0.5) -> DataFrame:
    """Rows(key, chrom, start, end) whose mean score is over the cutoff. Means are compared in nine decimals: the last bits of a sum of doubles depend on its
    order, and a mean equal to the cutoff isn't over it."""
    return rows.join(weighted_mean(rows, scores, key, width), key).where(F.round("mean_score", 9) > cutoff)


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """(reason, n): how often each of the reasons, joined by commas, is given."""
    return rows.select(F.explode(F.split(reasons, ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def screened(rows: DataFrame, key: str, seq: str, contigs: DataFrame, least: float = 0.9, invert: bool = False, index: DataFrame | None = None) -> DataFrame:
    """rows whose sequence (a consensus, or its distal part) stands in contigs(chrom, seq) with 1 - NM / M above `least` in any of its alignments; invert: the others, those
    without a sequence or an alignment among them. key is unique."""
    hits = aligned(rows.select(F.col(key).alias("query_id"), F.col(seq).alias("seq")), contigs, index)
    good = hits.where(cigar_match(F.col("cigar"), F.col("nm")) > least).select(F.col("query_id").alias(key)).distinct()
    return rows.join(good, key, "left_anti" if invert else "left_semi").select(*rows.columns)
