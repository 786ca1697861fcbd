"""Decisions over both ends of an insertion: which element, which way round, how long; and the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import only_poly_a, swap_strand

c = F.col
#: Hits that a task of best_ends takes, about.
ROWS = 1 << 19
HIT = ("target_id", "score", "target_start", "target_alnsize", "target_seqsize", "query_align", "target_align", "pct")


def best_ends(hits: DataFrame, ends: DataFrame, least: float = 0.9) -> DataFrame:
    """ins with be1 and be2, the alignments chosen for both ends (null if none), and their best match.

    hits(ins, be, HIT...), of which copies change nothing, ends(ins, be1_poly, be2_poly): the larger poly-A share of an end's sequences. The best hit of an end is that of the
    highest score (smallest target on ties) over `least`. If targets differ, the lower one (the first on a tie) is replaced by its best on
    the other's target if that costs fewer than 5 points, 20 for a poly-A end; if they still differ, poly-A alignments go; and if the ends
    disagreed at first and both are left, the lower one takes its best on the other's target or none."""
    good = hits.where(c("pct") > least).select("ins", "be", "target_id", F.struct(*HIT).alias("hit"))
    # One shuffle by insertion serves all that follows, in tasks of about as many rows whatever the input, so that none holds more of a larger one.
    tasks = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-good.count() // ROWS))
    by_target = good.repartition(tasks, "ins").groupBy("ins", "be", "target_id").agg(F.min_by("hit", F.struct((-c("hit.score")).alias("s"), c("hit.query_align"))).alias("hit"))
    # All best hits of an insertion, at most one for an element and end, in one row: nothing is joined with itself.
    held = by_target.groupBy("ins").agg(*[F.collect_list(F.when(c("be") == be, c("hit"))).alias(f"h{be}") for be in (1, 2)])
    top = lambda h: F.array_min(F.transform(h, lambda x: F.struct((-x["score"]).alias("s"), x["target_id"].alias("t"), x.alias("hit"))))["hit"]
    best = held.select("ins", "h1", "h2", top("h1").alias("b1"), top("h2").alias("b2"))
    on = lambda h, other: F.get(F.filter(h, lambda x: x["target_id"] == c(f"{other}.target_id")), F.lit(0))
    met = best.select("ins", "b1", "b2", on("h1", "b2").alias("n1"), on("h2", "b1").alias("n2")).join(ends, "ins", "left")
    differ = F.coalesce(c("b1.target_id") != c("b2.target_id"), F.lit(False))
    first_higher = c("b1.score") > c("b2.score")
    allowed = lambda poly: F.when(c(poly) > 0.75, 20).otherwise(5)
    step = met.select("*", differ.alias("differ"), F.when(differ & ~first_higher & (c("b1.score") - c("n1.score") < allowed("be1_poly")), c("n1")).otherwise(c("b1")).alias("r1"), F.when(differ & first_higher & (c("b2.score") - c("n2.score") < allowed("be2_poly")), c("n2")).otherwise(c("b2")).alias("r2"))
    still = F.coalesce(c("r1.target_id") != c("r2.target_id"), F.lit(False))
    step = step.select("ins", "differ", "n1", "n2", F.when(still & only_poly_a(c("r1.query_align")), None).otherwise(c("r1")).alias("r1"), F.when(still & only_poly_a(c("r2.query_align")), None).otherwise(c("r2")).alias("r2"))
    last = c("differ") & c("r1").isNotNull() & c("r2").isNotNull()
    out = step.select("ins", F.when(last & ~(c("r1.score") > c("r2.score")), c("n1")).otherwise(c("r1")).alias("be1"), F.when(last & (c("r1.score") > c("r2.score")), c("n2")).otherwise(c("r2")).alias("be2"))
    return out.withColumn("best_match", F.greatest("be1.pct", "be2.pct"))


def be1_is_3prime() -> Column:
    """Of be1 and be2: the end whose target starts farther on; of one end, if it is less than 10 bases from the element's end or ends in ten A. The other end is the opposite."""

    def alone(be: str) -> Column:
        near = c(f"{be}.target_seqsize") - c(f"{be}.target_start") - c(f"{be}.target_alnsize") < 10
        return near | F.endswith(c(f"{be}.query_align"), F.lit("A" * 10)) | F.endswith(c(f"{be}.target_align"), F.lit("A" * 10))

    return F.when(c("be1").isNotNull() & c("be2").isNotNull(), c("be1.target_start") > c("be2.target_start")).when(c("be1").isNotNull(), alone("be1")).when(c("be2").isNotNull(), ~alone("be2"))


def insertion_length() -> Column:
    """Span of the element between both ends; of a single 5' end, what follows it in the element; else null."""
    start, end = lambda be: c(f"{be}.target_start"), lambda be: c(f"{be}.target_start") + c(f"{be}.target_alnsize")
    both = F.greatest(end("be1"), end("be2")) - F.least(start("be1"), start("be2"))
    rest = lambda be: c(f"{be}.target_seqsize") - start(be)
    return F.when(c("be1").isNotNull() & c("be2").isNotNull(), both).when(c("be1").isNotNull() & ~c("is_3prime"), rest("be1")).when(c("be2").isNotNull() & c("is_3prime"), rest("be2"))


def orientation(prox_seq: Column, prox_start: Column, prox_end: Column, prox_strand: Column, is_3prime: Column) -> Column:
    """Of an end: + if the inserted part is left of the proximal one at a 3' end or right of it at a 5' end; turned with the proximal strand."""
    left = prox_start > F.length(prox_seq) - prox_end
    out = F.when(is_3prime == left, "+").when(is_3prime != left, "-")
    return F.when(prox_strand == "-", swap_strand(out)).otherwise(out)


def best_element() -> Column:
    """The element both ends agree on; a poly-A end yields to the other, a lower score to a higher; null if equal scores differ."""
    a, b = c("be1"), c("be2")
    both = F.when(a["target_id"] == b["target_id"], a["target_id"]).when(only_poly_a(a["query_align"]), b["target_id"]).when(only_poly_a(b["query_align"]), a["target_id"]).when(a["score"] > b["score"], a["target_id"]).when(a["score"] < b["score"], b["target_id"])
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a["target_id"], b["target_id"]))


#: Columns of the result that are the resolved ends' own: name without end, field of an end, what stands for none.
BY_END = (("Elt_Match", "pct", 0.0), ("Genome_Match", "avg_match", 0.0), ("Cons_Len", "cons_len", 0))


def result_table(calls: DataFrame, unmapped: bool = False) -> DataFrame:
    """The call table of calls(uuid, chrom, low, high, be1_is_3prime, element, end1, end2, remap_*): ends by 5' and 3', families, element coordinates, support.

    end1, end2: structs of pct, avg_match, cons_len, sr, start, end, orient, samples (an array of `sample|n`). unmapped: be1 is 3' where that isn't known."""
    is3 = F.coalesce(c("be1_is_3prime"), F.lit(True)) if unmapped else c("be1_is_3prime")
    five, three = F.when(is3, c("end2")).when(~is3, c("end1")), F.when(is3, c("end1")).when(~is3, c("end2"))
    laid = calls.withColumns({"five": five, "three": three})
    total = F.coalesce(c("five.sr"), F.lit(0)) + F.coalesce(c("three.sr"), F.lit(0))
    share = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))
    names = lambda e: F.transform(F.coalesce(c(f"{e}.samples"), F.expr("cast(array() as array<string>)")), lambda s: F.substring_index(s, "|", 1))
    return laid.select(
        c("uuid").alias("UUID"), c("chrom").alias("Chromosome"), c("low").alias("Left_Extreme"), c("high").alias("Right_Extreme"),
        F.when(is3, "be2").when(~is3, "be1").alias("5_Prime_End"), F.when(is3, "be1").when(~is3, "be2").alias("3_Prime_End"),
        F.substring_index("element", ":", 1).alias("Superfamily"), F.get(F.split("element", ":"), F.lit(1)).alias("Subfamily"),
        F.least("five.start", "remap_min").alias("TE_Align_Start"), F.greatest("three.end", "remap_max").alias("TE_Align_End"),
        c("five.orient").alias("Orient_5p"), c("three.orient").alias("Orient_3p"), F.when(c("five.orient") != c("three.orient"), "Y").when(c("five.orient") == c("three.orient"), "N").alias("Inversion"),
        *[F.coalesce(c(f"{e}.{f}"), F.lit(none)).alias(f"{p}_{n}") for n, f, none in BY_END for e, p in (("five", "5p"), ("three", "3p"))],
        F.coalesce("five.sr", F.lit(0)).alias("Split_reads_5prime"), F.coalesce("three.sr", F.lit(0)).alias("Split_reads_3prime"),
        c("remap_dr").alias("Remapped_Discordant"), share(c("remap_dr"), c("dr")).alias("Remap_Disc_Fraction"), c("remap_sr").alias("Remapped_Splitreads"), share(c("remap_sr"), total).alias("Remap_Split_Fraction"),
        F.array_join("five.samples", ",").alias("Sample_support_5p"), F.array_join("three.samples", ",").alias("Sample_support_3p"), F.size(F.array_union(names("five"), names("three"))).cast("long").alias("Sample_count"),
    )


def repaired_ids(calls: DataFrame, library: DataFrame) -> DataFrame:
    """calls with the superfamily that library(superfamily, subfamily) has for their subfamily, the greatest if there are several; calls without one stay as they are."""
    known = library.where(c("subfamily").isNotNull()).groupBy(c("subfamily").alias("known_sub")).agg(F.max("superfamily").alias("known_super"))
    return calls.join(F.broadcast(known), c("Subfamily") == c("known_sub"), "left").withColumn("Superfamily", F.coalesce("known_super", "Superfamily")).select(*calls.columns)  # some dozens of elements


def remap_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, remap_min, remap_max, remap_dr, remap_sr) of hits(keys, qname, start, end): names end in .DR or .SR."""
    kind = F.element_at(F.split("qname", r"\."), -1)
    return hits.groupBy(*keys).agg(F.min("start").alias("remap_min"), F.max("end").alias("remap_max"), F.count_if(kind == "DR").alias("remap_dr"), F.count_if(kind == "SR").alias("remap_sr"))


def vcf_calls(calls: DataFrame, counts: DataFrame, reference: bool = False, least_depth: int = 10) -> DataFrame:
    """(chrom, pos, id, info, bam, value) of calls(site, chrom, pos, ...) and counts(site, bam, alt, ref): `GT:DS` of each file.

    reference: the element stands in the reference, so that reads with it are the reference's and the dose is 2 - 2 vaf; else it is 2 vaf."""
    depth = c("alt") + c("ref")
    vaf = F.coalesce(F.try_divide(c("alt").cast("double"), depth), F.lit(0.0))
    dose = F.when(depth < least_depth, 0.0).otherwise(2 - 2 * vaf if reference else 2 * vaf)
    gt = F.when(depth < least_depth, "./.").when((dose > 0.3) & (dose < 1.7), "0/1").when(dose < 0.3, "0/0").otherwise("1/1")
    return calls.join(counts, "site").select("chrom", "pos", c("site").alias("id"), F.concat(F.lit("SVTYPE=INS;ME="), c("element")).alias("info"), "bam", F.concat_ws(":", gt, F.format_string("%.3f", dose)).alias("value"))


def features(calls: DataFrame) -> DataFrame:
    """calls of the result table, and genotypes (`bam|alt|ref|vaf`, joined by commas), with the numbers that outlier tests take."""
    entries = F.filter(F.split(F.coalesce("genotypes", F.lit("")), ","), lambda g: g != "")
    part = lambda i: F.transform(entries, lambda g: F.element_at(F.split(g, r"\|"), i).cast("double"))
    flag = lambda x: F.when(c(x) == "Y", 1).otherwise(0)
    n = F.greatest(c("Sample_count"), F.lit(1))
    tsd5, tsd3 = F.coalesce("TSD_5prime", F.lit("")), F.coalesce("TSD_3prime", F.lit(""))
    return calls.withColumns({
        "f_split": (c("Split_reads_5prime") + c("Split_reads_3prime")) / n, "f_disc": c("Remapped_Discordant") / n, "f_inverted": flag("Inversion"),
        "f_tsd_length": F.greatest(F.length(tsd5), F.length(tsd3)), "f_tsd_distance": F.levenshtein(tsd5, tsd3), "f_tsd_bases": F.size(F.array_distinct(F.filter(F.split(tsd5, ""), lambda x: x != ""))),
        "f_max_vaf": F.coalesce(F.array_max(part(4)), F.lit(0.0)), "f_max_depth": F.coalesce(F.array_max(F.zip_with(part(2), part(3), lambda a, r: a + r)), F.lit(0.0)), "f_length": F.coalesce(c("TE_Align_End") - c("TE_Align_Start"), F.lit(0)),
    })
