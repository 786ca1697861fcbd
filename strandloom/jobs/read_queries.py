"""Queries of the operators on reads, breakends, calls and alignments, each with the SQL that gives the same rows.

Reads, sites, calls and alignments are derived from the driver's tables by Spark: a line item is a read, with a CIGAR,
letters and qualities that say what the SQL says in numbers; a part is a site; an order is an insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.operators import breakends as be
from strandloom.operators import clusters as cl
from strandloom.operators import evidence as ev
from strandloom.operators import filters as fl
from strandloom.operators import intervals as iv
from strandloom.operators import outliers, pairing
from strandloom.operators.lineage import cut, written
from strandloom.operators import reads as rd
from strandloom.operators import resolve as rs

from .registry import _t, query

_L = "(SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"
_READS = f"""x AS (SELECT *, 'b' || (o % 3) AS bam, 'r' || o AS qname, 'c' || (s % 5) AS chrom, 1000 + (p * 9973 + o * 31) % 1000000 AS pos, CASE WHEN q % 3 = 0 THEN o % 25 ELSE o % 3 END AS lc, CASE WHEN q % 3 = 1 THEN p % 25 ELSE p % 3 END AS rc, 60 + s % 40 AS alen, (o + p) % 61 AS mapq,
'c' || ((s + CASE WHEN p % 4 = 0 THEN 1 ELSE 0 END) % 5) AS mate_chrom, p % 17 = 0 AS unmapped, o % 11 = 0 AS dup, n = 7 AS extra, o % 19 = 0 AS mate_unmapped FROM {_L}),
reads AS (SELECT *, lc + alen + rc AS rlen, pos + alen AS ref_end, pos + (p % 3) * 10000 AS mate_pos FROM x),
cl AS (SELECT *, CASE WHEN lc < rc THEN 'right' ELSE 'left' END AS side, CASE WHEN lc < rc THEN ref_end - 1 ELSE pos END AS breakpos, lc + rc AS cliplen, 1 - n / alen::DOUBLE AS matchpct, (pos + ref_end - 1) // 2 AS middle FROM reads WHERE NOT unmapped AND NOT dup AND lc + rc >= 3 AND least(lc, rc) <= 2 AND p % 6 <= 4 AND o % 13 <> 0)"""


def _x(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))


def _bit(test: str, bit: int) -> Column:
    return F.when(F.expr(test), bit).otherwise(0)


def _letters(n: Column, start: str = "", fill: str = "ACGT") -> Column:
    return F.call_function("rpad", F.expr(start) if start else F.lit(""), n, F.lit(fill))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """Aligned reads with CIGARs, letters and qualities."""
    e = F.expr
    rows = _x(spark, d).withColumns({"lc": e("if(q % 3 = 0, o % 25, o % 3)"), "rc": e("if(q % 3 = 1, p % 25, p % 3)"), "m": e("60 + s % 40"), "pos": e("1000 + (p * 9973 + o * 31) % 1000000")})
    rows = rows.withColumn("len", e("cast(lc + m + rc as int)"))
    part = lambda c, op: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(op))).otherwise("")
    frame = rows.select(
        "o", "n", "p", "s", F.concat(F.lit("/data/b"), e("o % 3").cast("string")).alias("bam"), F.lit(None).cast("string").alias("rg"), F.concat(F.lit("r"), F.col("o").cast("string")).alias("qname"),
        (F.lit(1) + _bit("p % 17 = 0", 4) + _bit("o % 19 = 0", 8) + _bit("s % 2 = 1", 16) + F.when(e("n % 2 = 1"), 96).otherwise(128) + _bit("n = 7", 2048) + _bit("o % 11 = 0", 1024)).alias("flag"),
        F.concat(F.lit("c"), e("s % 5").cast("string")).alias("chrom"), "pos", e("cast((o + p) % 61 as int)").alias("mapq"), F.concat(part("lc", "S"), F.col("m").cast("string"), F.lit("M"), part("rc", "S")).alias("cigar"),
        F.concat(F.lit("c"), e("(s + if(p % 4 = 0, 1, 0)) % 5").cast("string")).alias("mate_chrom"), e("pos + (p % 3) * 10000").alias("mate_pos"), _letters(F.col("len"), "repeat('N', cast(p % 6 as int))").alias("seq"),
        F.when(e("o % 13 = 0"), F.concat(_letters(F.col("len") - 1, fill="I"), F.lit("!"))).otherwise(_letters(F.col("len"), fill="I")).alias("qual"), F.col("n").cast("int").alias("nm"),
    )
    return rd.with_alignment(frame).withColumn("bam", rd.sample_of())


def _split(spark: SparkSession, d: str) -> DataFrame:
    return rd.split_reads(rd.clipped(_reads(spark, d)))


@query(f"WITH {_READS} SELECT o, n, chrom, side, breakpos, cliplen, round(matchpct, 6) AS matchpct, bam FROM cl")
def q52_clipped_reads(spark, d):
    return _split(spark, d).select("o", "n", "chrom", "side", "breakpos", F.col("cliplen").cast("long").alias("cliplen"), F.round("matchpct", 6).alias("matchpct"), "bam")


@query(f"""WITH RECURSIVE {_READS}, g AS (SELECT chrom, breakpos, middle, CASE WHEN breakpos - lag(greatest(breakpos, middle)) OVER (PARTITION BY chrom ORDER BY breakpos, middle) <= 100 THEN 0 ELSE 1 END AS nw FROM cl),
k AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY breakpos, middle ROWS UNBOUNDED PRECEDING) AS chain FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY chrom, chain ORDER BY breakpos, middle) AS rn FROM k),
f AS (SELECT chrom, chain, rn, [breakpos] AS l, middle AS med, 1 AS cid FROM r WHERE rn = 1 UNION ALL
SELECT r.chrom, r.chain, r.rn, CASE WHEN abs(f.med - r.breakpos) > 100 THEN [r.breakpos] ELSE list_append(f.l, r.breakpos) END,
CASE WHEN abs(f.med - r.breakpos) > 100 THEN r.middle ELSE list_append(f.l, r.breakpos)[(len(f.l) + 1) // 2 + 1] END, CASE WHEN abs(f.med - r.breakpos) > 100 THEN cid + 1 ELSE cid END
FROM f JOIN r ON r.chrom = f.chrom AND r.chain = f.chain AND r.rn = f.rn + 1)
SELECT chrom, min(l[1]) AS first, max(l[len(l)]) AS last, count(*) AS n FROM f GROUP BY chrom, chain, cid""")
def q53_sr_clusters(spark, d):
    return be.sr_clusters(_split(spark, d))


_ENDS = f"""{_READS}, per AS (SELECT chrom, breakpos, side, bam, count(*) AS n, max(cliplen) AS clip, sum(matchpct) AS sm, max(mapq) AS mq FROM cl GROUP BY ALL),
ends AS (SELECT chrom, breakpos, side, CAST(sum(n) AS BIGINT) AS n_reads, max(clip) AS max_clip, sum(sm) / sum(n) AS avg_match, max(n) AS max_per_sample, string_agg(bam || '|' || n, ',' ORDER BY bam || '|' || n) AS samples, max(mq) AS max_mapq FROM per GROUP BY ALL HAVING sum(n) >= 1 AND max(clip) >= 10)"""


@query(f"WITH {_ENDS} SELECT chrom, breakpos, side, n_reads, max_clip, round(avg_match, 6) AS avg_match, max_per_sample, samples, max_mapq FROM ends")
def q54_breakends(spark, d):
    return be.breakends(_split(spark, d)).withColumns({"avg_match": F.round("avg_match", 6), "max_clip": F.col("max_clip").cast("long"), "max_mapq": F.col("max_mapq").cast("long")})


_PAIRS = f"""{_ENDS}, bp AS (SELECT a.chrom, a.breakpos AS left_pos, b.breakpos AS right_pos, a.n_reads AS left_n, b.n_reads AS right_n, greatest(0, b.breakpos - a.breakpos + 1)::DOUBLE AS ov FROM ends a JOIN ends b ON a.chrom = b.chrom AND a.side = 'left' AND b.side = 'right' AND abs(a.breakpos - b.breakpos) <= 100)"""


@query(f"""WITH {_PAIRS} SELECT chrom, left_pos, right_pos, left_n, right_n, round(pow(ov, 1.5) * exp(-ov / 3.0) / (1.3293403881791370::DOUBLE * pow(3.0::DOUBLE, 2.5)) * ov * ov
- CASE WHEN ov > 0 THEN abs(abs(left_pos - right_pos)::DOUBLE - ov) ELSE abs(left_pos - right_pos)::DOUBLE END + left_n + right_n, 4) AS score FROM bp""")
def q55_breakend_pairs(spark, d):
    return be.breakend_pairs(be.breakends(_split(spark, d)))


@query()
def q56_matched_breakends(spark, d):
    """Greedy matching in blocks of positions; breakends without a partner stay single. No SQL: the choice is sequential; a test compares it with a loop."""
    ends = cut(be.breakends(_split(spark, d))).withColumn("id", F.concat_ws(":", "chrom", "side", F.col("breakpos").cast("string")))
    name = lambda side: F.concat_ws(f":{side}:", "chrom", F.col(f"{side}_pos").cast("string"))
    taken = be.matched(ends).select(name("left").alias("l"), name("right").alias("r"), "score")
    return pairing.with_leftovers(taken, ends.where("side = 'left'").select(F.col("id").alias("l")), ends.where("side = 'right'").select(F.col("id").alias("r")), "l", "r")


@query(f"""WITH {_READS}, i AS (SELECT chrom, breakpos // 500 AS bin, bam, count(*) AS n, max(mapq) AS mq FROM cl GROUP BY ALL), g AS (SELECT chrom, bin, CAST(sum(n) AS BIGINT) AS n_split, max(n) AS most, count(*) AS n_samples, max(mq) AS mq, max(bam = 'b2') AS has_b2 FROM i GROUP BY ALL)
SELECT chrom, bin, coalesce(nullif(concat_ws(',', CASE WHEN mq < 10 THEN 'mapq' END, CASE WHEN n_split < 4 THEN 'split' WHEN most < 4 THEN 'split_per_sample' END, CASE WHEN has_b2 AND bin % 5 = 0 THEN 'excluded' END, CASE WHEN n_samples > 2 THEN 'samples' END), ''), CASE WHEN (bin % 10) / 20.0 < 0.1 THEN 'mappability' ELSE 'PASS' END) AS reason FROM g""")
def q57_insertion_filter(spark, d):
    per = _split(spark, d).groupBy("chrom", F.floor(F.col("breakpos") / 500).alias("bin"), "bam").agg(F.count(F.lit(1)).alias("n"), F.max("mapq").alias("mq"))
    g = per.groupBy("chrom", "bin").agg(F.sum("n").alias("n_split"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n_samples"), F.max("mq").alias("mq"), F.bool_or(F.col("bam") == "b2").alias("has_b2"))
    reason = be.insertion_reasons(F.col("mq"), F.col("n_split"), F.col("most"), F.col("n_samples"), F.col("has_b2") & (F.col("bin") % 5 == 0), (F.col("bin") % 10) / 20.0, most_samples=2)
    return g.select("chrom", "bin", reason.alias("reason"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    low = F.expr("1000 + (p_partkey * 9973) % 1000000")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("site"), F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("site_chrom"), low.alias("low"), (low + F.col("p_partkey") % 8).alias("high"))


_SITES = "sites AS (SELECT p_partkey AS site, 'c' || (p_partkey % 5) AS sc, 1000 + (p_partkey * 9973) % 1000000 AS low, 1000 + (p_partkey * 9973) % 1000000 + p_partkey % 8 AS high FROM part)"
_NEAR = "near AS (SELECT * FROM (SELECT * FROM reads WHERE NOT unmapped AND NOT dup AND mapq >= {mapq}) JOIN sites ON chrom = sc AND pos < high + {pad} + 1 AND ref_end > greatest(low - {pad}, 0))"
_COUNTS = f"""{_READS}, {_SITES}, {_NEAR.format(mapq=10, pad=5)}, fl AS (SELECT *, ((rc > greatest(high - low, 5)) AND (abs(ref_end - low) <= 1 OR abs(ref_end - high) <= 1)) OR ((lc > greatest(high - low, 5)) AND (abs(pos - low) <= 1 OR abs(pos - high) <= 1)) AS is_alt FROM near),
cn AS (SELECT site, bam, count(*) FILTER (is_alt) AS alt, count(*) FILTER (NOT is_alt AND lc + rc = 0 AND pos < low AND ref_end > high) AS ref FROM fl GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT site, bam, alt, ref, round(coalesce(alt / nullif(alt + ref, 0)::DOUBLE, 0), 6) AS vaf FROM cn")
def q58_genotype_counts(spark, d):
    return be.break_counts(_reads(spark, d), _sites(spark, d)).withColumn("vaf", F.round("vaf", 6))


@query(f"WITH {_COUNTS} SELECT site, string_agg(bam || '|' || alt || '|' || ref || '|' || printf('%.3f', coalesce(alt / nullif(alt + ref, 0)::DOUBLE, 0)), ',' ORDER BY bam) AS genotypes, round(max(coalesce(alt / nullif(alt + ref, 0)::DOUBLE, 0)), 6) AS max_vaf FROM cn GROUP BY 1")
def q59_genotype_lists(spark, d):
    return be.genotype_lists(be.break_counts(_reads(spark, d), _sites(spark, d))).withColumn("max_vaf", F.round("max_vaf", 6))


@query(f"WITH {_READS}, {_SITES}, {_NEAR.format(mapq=0, pad=5)} SELECT site, count(*) FILTER ((lc > 5 AND abs(pos - low) <= 1) OR (rc > 5 AND abs(ref_end - low) <= 1)) AS n FROM near GROUP BY 1")
def q60_endpoint_counts(spark, d):
    return be.endpoint_counts(_reads(spark, d), _sites(spark, d))


@query(f"""WITH {_READS}, {_SITES}, {_NEAR.format(mapq=10, pad=200)}, e AS (SELECT site, low, pos AS p FROM near WHERE lc > 0 UNION ALL SELECT site, low, ref_end FROM near WHERE rc > 0), c AS (SELECT site, p, count(*) AS k FROM e WHERE abs(p - low) <= 200 GROUP BY ALL),
t AS (SELECT site, p, k, sum(k) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY k DESC, p) AS r FROM c) SELECT s.site, CASE WHEN n >= 2 AND k >= 0.5 * n THEN p ELSE low END AS junction, CAST(coalesce(n, 0) AS BIGINT) AS n FROM sites s LEFT JOIN t ON t.site = s.site AND r = 1""")
def q61_junction_modes(spark, d):
    return be.junction_modes(_reads(spark, d), _sites(spark, d), least=2)


_SUPPORT = "SELECT site, bam, count(*) FILTER (NOT r AND {clip} > 0 AND abs({edge} - low) <= 5 + high - low) AS alt, count(*) FILTER (r) AS ref FROM (SELECT *, lc + rc = 0 AND pos < low - 5 AND ref_end > high + 5 AS r FROM near) GROUP BY ALL"
_BOTH = f"{_READS}, {_SITES}, {_NEAR.format(mapq=10, pad=5)}, lft AS ({_SUPPORT.format(clip='lc', edge='pos')}), rgt AS ({_SUPPORT.format(clip='rc', edge='ref_end')})"


@query(f"WITH {_BOTH} SELECT * FROM lft")
def q62_junction_support(spark, d):
    return be.junction_support(_reads(spark, d), _sites(spark, d), "left")


@query(f"WITH {_BOTH}, b AS (SELECT site, bam, sum(alt) AS a, sum(alt + ref) AS t FROM (SELECT * FROM lft UNION ALL SELECT * FROM rgt) GROUP BY ALL) SELECT site, string_agg(bam || '|' || printf('%.3f', coalesce(a / nullif(t, 0)::DOUBLE, 0)), ',' ORDER BY bam) AS vafs FROM b GROUP BY 1")
def q63_reference_vaf(spark, d):
    both = written(be.junction_supports(_reads(spark, d), _sites(spark, d)))
    one = lambda side: both.select("site", "bam", F.col(f"alt_{side}").alias("alt"), "ref")
    return be.reference_vaf(one("left"), one("right"))


_FAR = "(chrom <> mate_chrom OR abs(pos - mate_pos) {op} 10000)"


@query(f"WITH {_READS} SELECT o, n FROM reads WHERE NOT unmapped AND NOT extra AND NOT dup AND mapq > 0 AND (mate_unmapped OR {_FAR.format(op='>')})")
def q64_discordant_near_site(spark, d):
    return rd.discordant_near_site(_reads(spark, d)).select("o", "n")


@query(f"""WITH {_READS} SELECT o, n, CASE WHEN s % 2 = 1 THEN '-' ELSE '+' END AS strand, CASE WHEN n % 2 = 1 THEN '-' ELSE '+' END AS mate_strand, mate_pos + rlen AS mate_end, CASE WHEN chrom <> mate_chrom THEN 3000000000 ELSE abs(pos - mate_pos) END AS apart
FROM reads WHERE NOT unmapped AND NOT mate_unmapped AND NOT dup AND mapq >= 1 AND {_FAR.format(op='>=')}""")
def q65_discordant(spark, d):
    return rd.discordant(_reads(spark, d)).select("o", "n", "strand", "mate_strand", "mate_end", "apart")


@query(f"WITH {_READS} SELECT o, n FROM reads WHERE NOT dup AND p % 6 < 4 AND (unmapped OR mate_unmapped OR lc >= 10 OR rc >= 10 OR {_FAR.format(op='>')})")
def q66_reduced_reads(spark, d):
    return rd.reduced(_reads(spark, d)).select("o", "n")


_MATED = f"(SELECT o, n, 'c' || (o % 5) AS chrom, 1000 + (o * 37) % 50000 + (n - 1) * (100 + o % 900) AS pos, 1000 + (o * 37) % 50000 + (2 - n) * (100 + o % 900) AS mate_pos, (o + n) % 61 AS mapq, n = 2 AND o % 7 = 0 AS unmapped, repeat('ACGT', CAST(n AS INT)) AS seq FROM {_L} WHERE n <= 2)"


def _mated(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    chrom = F.concat(F.lit("c"), e("o % 5").cast("string"))
    return _x(spark, d).where("n <= 2").select("o", "n", F.lit("b").alias("bam"), F.concat(F.lit("r"), F.col("o").cast("string")).alias("qname"), (F.lit(1) + F.when(e("n = 1"), 64).otherwise(128) + _bit("n = 2 and o % 7 = 0", 4)).alias("flag"), chrom.alias("chrom"), e("1000 + (o * 37) % 50000 + (n - 1) * (100 + o % 900)").alias("pos"), chrom.alias("mate_chrom"), e("1000 + (o * 37) % 50000 + (2 - n) * (100 + o % 900)").alias("mate_pos"), e("cast((o + n) % 61 as int)").alias("mapq"), e("repeat('ACGT', cast(n as int))").alias("seq"))


@query(f"SELECT a.o, a.n, b.seq AS mate_seq, b.mapq AS mate_mapq FROM {_MATED} a JOIN {_MATED} b ON a.o = b.o AND a.n <> b.n AND NOT b.unmapped AND a.mate_pos = b.pos")
def q67_mates(spark, d):
    r = _mated(spark, d)
    return rd.mates(r, r).select("o", "n", "mate_seq", F.col("mate_mapq").cast("long").alias("mate_mapq"))


@query(f"SELECT a.o, a.n, b.seq AS mate_seq FROM {_MATED} a JOIN {_MATED} b ON a.o = b.o AND a.n <> b.n AND b.unmapped")
def q68_unmapped_mates(spark, d):
    r = _mated(spark, d)
    return rd.mates(r, r, unmapped=True).select("o", "n", "mate_seq")


@query(f"SELECT ends, count(*) AS n FROM (SELECT o, count(DISTINCT n = 1) AS ends FROM {_MATED} GROUP BY o) GROUP BY 1")
def q69_pair_occupancy(spark, d):
    return rd.pair_occupancy(_mated(spark, d))


@query(f"WITH {_READS} SELECT bam, CAST(min(CASE WHEN o % 13 = 0 THEN 33 ELSE 73 END) AS BIGINT) AS minqual FROM reads GROUP BY 1")
def q70_least_quality(spark, d):
    return rd.least_quality(_reads(spark, d)).withColumn("minqual", F.col("minqual").cast("long"))


@query(f"""WITH {_READS}, e AS (SELECT chrom, pos AS a, 1 AS d FROM reads UNION ALL SELECT chrom, ref_end AS a, -1 AS d FROM reads), s AS (SELECT chrom, a, sum(d) AS d FROM e GROUP BY chrom, a HAVING sum(d) <> 0),
r AS (SELECT chrom, a AS start, lead(a) OVER (PARTITION BY chrom ORDER BY a) AS "end", CAST(sum(d) OVER (PARTITION BY chrom ORDER BY a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM s) SELECT * FROM r WHERE depth > 0""")
def q71_depth(spark, d):
    return cl.depth_runs(_reads(spark, d), "chrom", "pos", "ref_end")


@query(f"""WITH {_READS}, b AS (SELECT 'c' || c AS chrom, k * 50000 AS start FROM range(5) a(c), range(21) z(k)), m AS (SELECT count(*) FILTER (NOT unmapped) / 1e6::DOUBLE AS m FROM reads),
c AS (SELECT b.chrom, b.start, count(r.o) / m.m / 50000 AS cpm FROM m, b LEFT JOIN (SELECT chrom, pos // 50000 * 50000 AS start, o FROM reads WHERE mapq > 10 AND NOT unmapped) r ON r.chrom = b.chrom AND r.start = b.start GROUP BY b.chrom, b.start, m.m),
z AS (SELECT *, (cpm - avg(cpm) OVER ()) / nullif(stddev_pop(cpm) OVER (), 0) AS z FROM c) SELECT chrom, start, start + 50000 AS end, round(cpm, 6) AS cpm, round(z, 6) AS z FROM z WHERE z > 0.25""")
def q72_cpm_mask(spark, d):
    contigs = _reads(spark, d).select(F.col("chrom")).distinct().withColumn("size", F.lit(1_050_000).cast("long"))
    mapped = ~sq.has_flag(F.col("flag"), rd.UNMAPPED)
    masked = ev.cpm_mask(_reads(spark, d), cl.bins(contigs, "chrom", "size", 50_000), 50_000, mapped, mapped & (F.col("mapq") > 10), 0.25)
    return masked.withColumns({"cpm": F.round("cpm", 6), "z": F.round("z", 6)})


@query(f"""WITH {_READS}, k AS (SELECT chrom || ':' || (pos // 2000) AS chunk, (pos // 2000) % 3 AS kind, o, n FROM reads), c AS (SELECT chunk, count(*) AS m, CASE WHEN kind = 0 THEN 900 ELSE 2000 END AS span FROM k GROUP BY ALL)
SELECT o, n FROM k JOIN c USING (chunk) WHERE NOT CASE WHEN span <= 1000 THEN m > 1000 * 0.01 ELSE m > span * 0.01 * 1 END""")
def q73_density_chunks(spark, d):
    keyed = _reads(spark, d).withColumn("chunk", F.concat_ws(":", "chrom", F.floor(F.col("pos") / 2000).cast("string")))
    ids = keyed.select("chunk", F.floor(F.col("pos") / 2000).alias("k")).distinct().select("chunk", F.lit(0).alias("a"), F.when(F.col("k") % 3 == 0, 900).otherwise(2000).alias("z"))
    return ev.density_cap(keyed, ids, "chunk", "a", "z", 1, density=0.01).select("o", "n")


_CALLS = f"""calls AS (SELECT o, n, o * 10 + n AS uuid, CASE o % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'ALU' WHEN 2 THEN 'SVA' ELSE 'GENE.x' END AS sf, CASE p % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS sub, CASE WHEN p % 9 = 0 THEN NULL ELSE 'ACGT' END AS ic5, CASE WHEN p % 6 = 0 THEN NULL ELSE 'ACGT' END AS ic3, p % 300 AS cl3, o % 300 AS cl5,
0.85::DOUBLE + (p % 16) / 100.0::DOUBLE AS em5, 0.85::DOUBLE + (s % 16) / 100.0::DOUBLE AS em3, 0.9::DOUBLE + (o % 11) / 100.0::DOUBLE AS gm5, 0.9::DOUBLE + (n % 11) / 100.0::DOUBLE AS gm3, q AS disc, p % 7 AS sr5, o % 7 AS sr3, CASE o % 5 WHEN 0 THEN 'AAAAAAAAAAAAA' WHEN 1 THEN 'ACGTT' WHEN 2 THEN NULL ELSE 'ACGTACGT' END AS tsd3,
CASE o % 5 WHEN 0 THEN 'AAAAAAAAAAAA' WHEN 1 THEN CASE WHEN p % 2 = 0 THEN 'ACGTT' ELSE 'TTTTT' END WHEN 2 THEN NULL ELSE 'ACGTACGA' END AS tsd5, CASE WHEN p % 13 = 0 THEN NULL ELSE p % 100 END AS ts, CASE WHEN p % 13 = 0 THEN NULL ELSE p % 100 + o % 700 END AS te, CASE WHEN s % 10 = 0 THEN NULL ELSE (s % 20) / 20.0::DOUBLE END AS max_vaf,
CASE WHEN n % 2 = 0 THEN 'G' END AS gc3, CASE WHEN p % 5 = 0 THEN '1:A>C,2:A>C,3:A>G' WHEN p % 5 = 1 THEN '1:A>C' END AS vars, (o % 10) / 10.0::DOUBLE AS mp, CASE WHEN p % 8 = 0 THEN repeat('t', 25) ELSE repeat('ACGT', 10) END AS site_seq, p % 19 = 0 AS self, (s % 5) / 4.0::DOUBLE AS fraction, 'c' || (s % 5) AS chrom, 1000 + (p * 9973) % 1000000 AS low, 1000 + (p * 9973) % 1000000 + q AS high FROM {_L})"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    low = e("1000 + (p * 9973) % 1000000")
    three = lambda x, *names: F.when(e(x) == 0, names[0]).when(e(x) == 1, names[1]).otherwise(names[2])
    return _x(spark, d).select("o", "n", (F.col("o") * 10 + F.col("n")).alias("UUID"), F.when(e("o % 4 = 0"), "L1").when(e("o % 4 = 1"), "ALU").when(e("o % 4 = 2"), "SVA").otherwise("GENE.x").alias("Superfamily"), three("p % 3", "a", "b", "c").alias("Subfamily"), F.when(e("p % 9 <> 0"), "ACGT").alias("Insert_Consensus_5p"), F.when(e("p % 6 <> 0"), "ACGT").alias("Insert_Consensus_3p"), e("p % 300").alias("3p_Cons_Len"), e("o % 300").alias("5p_Cons_Len"), e("0.85D + (p % 16) / 100.0D").alias("5p_Elt_Match"), e("0.85D + (s % 16) / 100.0D").alias("3p_Elt_Match"), e("0.9D + (o % 11) / 100.0D").alias("5p_Genome_Match"), e("0.9D + (n % 11) / 100.0D").alias("3p_Genome_Match"), F.col("q").alias("Remapped_Discordant"), e("p % 7").alias("Split_reads_5prime"), e("o % 7").alias("Split_reads_3prime"),
        e("case o % 5 when 0 then 'AAAAAAAAAAAAA' when 1 then 'ACGTT' when 2 then null else 'ACGTACGT' end").alias("TSD_3prime"), e("case o % 5 when 0 then 'AAAAAAAAAAAA' when 1 then if(p % 2 = 0, 'ACGTT', 'TTTTT') when 2 then null else 'ACGTACGA' end").alias("TSD_5prime"), e("if(p % 13 = 0, null, p % 100)").alias("TE_Align_Start"), e("if(p % 13 = 0, null, p % 100 + o % 700)").alias("TE_Align_End"), e("if(s % 10 = 0, null, (s % 20) / 20.0D)").alias("max_vaf"), e("if(n % 2 = 0, 'G', null)").alias("Genomic_Consensus_3p"), e("case p % 5 when 0 then '1:A>C,2:A>C,3:A>G' when 1 then '1:A>C' end").alias("Variants"), e("(o % 10) / 10.0D").alias("mappability"), e("if(p % 8 = 0, repeat('t', 25), repeat('ACGT', 10))").alias("site_seq"), e("p % 19 = 0").alias("self"), e("(s % 5) / 4.0D").alias("Remap_Disc_Fraction"), F.concat(F.lit("c"), e("s % 5").cast("string")).alias("Chromosome"), low.alias("Left_Extreme"), (low + F.col("q")).alias("Right_Extreme"))


def _library(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT s || ':' || x AS seq_id, repeat('A', 500) AS seq FROM (SELECT explode(array('L1', 'ALU', 'GENE.x')) AS s) LATERAL VIEW explode(array('a', 'b')) AS x")


_FINAL = """CASE WHEN ic5 IS NULL AND ic3 IS NULL THEN 'NoConsMapRef' END, CASE WHEN cl3 + cl5 < 250 THEN 'TotalConsLen' END, CASE WHEN greatest(em5, em3) < 0.9::DOUBLE THEN 'MinEltMatch' END, CASE WHEN greatest(gm5, gm3) < 0.98::DOUBLE THEN 'MinRefMatch' END, CASE WHEN disc < 4 THEN 'MinDiscord' END, CASE WHEN sr5 + sr3 < 4 THEN 'MinSplit' END,
CASE WHEN levenshtein(coalesce(tsd3, 'NA'), coalesce(tsd5, 'NA')) > 1 THEN 'MismatchTSD' WHEN o % 5 = 0 THEN 'LongHomopolTSD' END, CASE WHEN te - ts < 300 THEN 'MinTELength' END, CASE WHEN max_vaf IS NULL THEN 'MissingVAF' END, CASE WHEN coalesce(max_vaf, 0) < 0.1::DOUBLE THEN 'MinVAF' END, CASE WHEN gc3 IS NOT NULL AND te IS NOT NULL AND (500 - te) / 500::DOUBLE > 0.5 THEN 'FracEnd' END, CASE WHEN p5 > 2 THEN 'MaxVars' END"""


@query(f"""WITH {_CALLS}, v AS (SELECT *, CASE WHEN vars IS NULL THEN 1 ELSE length(vars) - length(replace(vars, ',', '')) + 1 END AS p5 FROM calls), e AS (SELECT *, concat_ws(',', {_FINAL}) AS early, concat_ws(',', CASE WHEN mp < 0.5::DOUBLE THEN 'LowMap' END, CASE WHEN length(site_seq) = 25 THEN 'HomopolSite' END, CASE WHEN self THEN 'SelfAlign' END) AS late FROM v)
SELECT uuid, CASE WHEN sf = 'SVA' OR sub = 'c' THEN 'UnknownInsType' ELSE coalesce(nullif(early, ''), nullif(late, ''), 'PASS') END AS filter FROM e""")
def q74_final_filter(spark, d):
    met = fl.with_library(_calls(spark, d), _library(spark))
    limits = {"te_length": 300, "vaf": 0.1, "frac_end": 0.5, "variants": 2, "map": 0.5}
    return met.select(F.col("UUID").alias("uuid"), fl.final_reasons(F.col("elt_length").isNotNull(), limits, F.col("elt_length").cast("double"), F.col("self")).alias("filter"))


@query(f"""WITH {_CALLS} SELECT uuid, CASE WHEN greatest(gm5, gm3) < 0.98::DOUBLE THEN 'minmatch' WHEN disc < 4 THEN 'mindisc' WHEN sr5 + sr3 < 4 THEN 'minsplit' WHEN ic5 IS NULL AND ic3 IS NULL THEN 'mapends' WHEN o % 10 = 0 THEN 'uuidlist' ELSE 'kept' END AS reason FROM calls""")
def q75_prefilter(spark, d):
    ends = _calls(spark, d).withColumns({"be1_avgmatch": F.col("5p_Genome_Match"), "be2_avgmatch": F.col("3p_Genome_Match"), "dr_count": F.col("Remapped_Discordant"), "be1_sr_count": F.col("Split_reads_5prime"), "be2_sr_count": F.col("Split_reads_3prime"), "be1_dist_seq": F.col("Insert_Consensus_5p"), "be2_dist_seq": F.col("Insert_Consensus_3p")})
    return ends.select(F.col("UUID").alias("uuid"), F.coalesce(fl.prefilter(listed=F.col("o") % 10 != 0), F.lit("kept")).alias("reason"))


@query(f"""WITH {_CALLS} SELECT uuid, concat_ws(',', CASE WHEN n % 3 = 0 THEN 'no_ends' END, CASE WHEN ic5 IS NULL AND ic3 IS NULL THEN 'insert_consensus' END, CASE WHEN cl3 + cl5 < 250 THEN 'min_cons_len' END, CASE WHEN greatest(cl3 % 30, CASE WHEN o % 2 = 0 THEN o % 15 + 6 ELSE 0 END) < 20 THEN 'prox_len' END, CASE WHEN self THEN 'end_align_flush' END) AS reasons FROM calls""")
def q76_resolve_filter(spark, d):
    e = F.expr
    seen = _calls(spark, d).withColumns({"5_Prime_End": e("if((UUID - o * 10) % 3 = 0, null, 'be1')"), "3_Prime_End": e("if((UUID - o * 10) % 3 = 0, null, 'be2')"), "end_flush": ~F.col("self")})
    # The proximal sequences' lengths are those of the SQL: one of p % 30 letters, and two that join to o % 15 + 6.
    one = F.array(F.call_function("repeat", F.lit("A"), e("cast(pp % 30 as int)")))
    two = F.when(e("o % 2 = 0"), F.array(F.call_function("repeat", F.lit("A"), e("cast(o % 15 as int)")), F.lit("ACGTA")))
    rows = seen.withColumn("pp", F.expr("`3p_Cons_Len`"))  # p % 300, whose remainder by 30 is p % 30
    return rows.withColumns({"be1_prox_seq": one, "be2_prox_seq": two}).select(F.col("UUID").alias("uuid"), F.array_join(fl.resolve_reasons(), ",").alias("reasons"))


_RULES = "rules(f, em, rm, disc, fr, mp, lo, hi) AS (VALUES ('L1', 0.95::DOUBLE, 0.98::DOUBLE, 4, 0.5::DOUBLE, 0.1::DOUBLE, 100, 5950), ('ALU', 0.95, 0.98, 4, 0.5, 0.1, 50, NULL), ('*', 0.9, 0.98, 4, 0.25, NULL, NULL, NULL))"
_ELTS = "elts AS (SELECT 'c' || (p_partkey % 5) AS b_chrom, 1000 + (p_partkey * 7919) % 1000000 AS bs, 1000 + (p_partkey * 7919) % 1000000 + 300 AS be, CASE p_partkey % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'ALU' WHEN 2 THEN 'SVA' ELSE 'GENE' END AS fam FROM part)"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("1000 + (p_partkey * 7919) % 1000000")
    return _t(spark, d, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("b_chrom"), start.alias("b_start"), (start + 300).alias("b_end"), F.expr("case p_partkey % 4 when 0 then 'L1' when 1 then 'ALU' when 2 then 'SVA' else 'GENE' end").alias("b_family"))


@query(f"""WITH {_CALLS}, {_RULES}, {_ELTS}, r AS (SELECT c.* FROM calls c JOIN rules r ON r.f = CASE WHEN c.sf IN ('L1', 'ALU') THEN c.sf ELSE '*' END WHERE greatest(cl5, cl3) >= 120 AND te IS NOT NULL AND greatest(em5, em3) >= r.em AND greatest(gm5, gm3) >= r.rm AND c.disc >= r.disc AND fraction >= r.fr AND coalesce(c.mp >= r.mp, true)
AND NOT (ic5 IS NULL AND ic3 IS NULL) AND coalesce(te - ts >= r.lo, true) AND coalesce(te - ts <= r.hi, true)), hit AS (SELECT DISTINCT uuid FROM r JOIN elts ON chrom = b_chrom AND low < be AND high > bs AND fam = sf) SELECT uuid, sf FROM r WHERE uuid NOT IN (SELECT uuid FROM hit)""")
def q77_species_filter(spark, d):
    rules = spark.createDataFrame([("L1", 0.95, 0.98, 4, 0.5, 0.1, 100, 5950), ("ALU", 0.95, 0.98, 4, 0.5, 0.1, 50, None), ("*", 0.9, 0.98, 4, 0.25, None, None, None)], "rule_family string, elt_match double, ref_match double, disc int, disc_fraction double, map double, least_length int, most_length int")
    return fl.species_filter(_calls(spark, d), rules, _elements(spark, d)).select(F.col("UUID").alias("uuid"), F.col("Superfamily").alias("sf"))


@query(f"""WITH {_CALLS}, {_ELTS}, g AS (SELECT * FROM calls WHERE greatest(cl5, cl3) >= 120 AND te - ts >= 400 AND tsd3 IS NOT DISTINCT FROM tsd5 AND least(sr5, sr3) >= 1 AND fraction >= 0.5 AND greatest(em5, em3) >= 0.95::DOUBLE AND least(em5, em3) >= 0.9::DOUBLE AND greatest(gm5, gm3) >= 0.98::DOUBLE AND least(gm5, gm3) >= 0.9::DOUBLE AND disc >= 4 AND mp >= 0.2::DOUBLE)
SELECT uuid FROM g WHERE uuid NOT IN (SELECT uuid FROM g JOIN elts ON chrom = b_chrom AND low < be AND greatest(high, low + 1) > bs AND fam = 'SVA') AND uuid NOT IN (SELECT uuid FROM g JOIN elts ON chrom = b_chrom AND low < be AND greatest(high, low + 1) > bs AND sf = 'GENE.x' AND fam = 'GENE')""")
def q78_gene_filter(spark, d):
    e = _elements(spark, d)
    calls = _calls(spark, d).withColumn("3p_Genome_Match", F.greatest("3p_Genome_Match", F.when(F.col("3p_Genome_Match") >= 0.9, 0.95))).withColumn("5p_Genome_Match", F.when(F.col("5p_Genome_Match") >= 0.98, F.col("5p_Genome_Match")).otherwise(F.greatest("5p_Genome_Match", F.when(F.col("5p_Genome_Match") >= 0.9, 0.95))))
    return fl.gene_filter(calls, e.where("b_family = 'SVA'"), e.withColumn("gene", F.col("b_family")), least_map=0.2).select(F.col("UUID").alias("uuid"))


@query(f"""WITH {_CALLS}, {_ELTS}, e AS (SELECT *, (bs % 100) / 100.0::DOUBLE AS score FROM elts), k AS (SELECT DISTINCT chrom, low, high FROM calls WHERE high > low), m AS (SELECT chrom, low, high, sum(greatest(0, least(be, high) - greatest(bs + 1, low) + 1) * score) / nullif(sum(greatest(0, least(be, high) - greatest(bs + 1, low) + 1)), 0) AS v FROM k JOIN e ON chrom = b_chrom AND low < be AND high > bs GROUP BY ALL)
SELECT chrom, low AS start, high AS end, round(v, 6) AS mean_score FROM m WHERE v > 0.5""")
def q79_map_filter(spark, d):
    spans = _calls(spark, d).select(F.col("Chromosome").alias("chrom"), F.col("Left_Extreme").alias("start"), F.col("Right_Extreme").alias("end")).where(F.col("end") > F.col("start")).distinct()
    scores = _elements(spark, d).withColumn("score", F.col("b_start") % 100 / 100.0)
    return fl.map_filter(spans, scores, ["chrom", "start", "end"], 1024).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {_CALLS}, f AS (SELECT unnest(string_split(concat_ws(',', CASE WHEN cl3 + cl5 < 250 THEN 'TotalConsLen' END, CASE WHEN disc < 4 THEN 'MinDiscord' END, 'any'), ',')) AS reason FROM calls) SELECT reason, count(*) AS n FROM f GROUP BY 1")
def q80_reason_counts(spark, d):
    found = F.concat_ws(",", F.when(F.col("3p_Cons_Len") + F.col("5p_Cons_Len") < 250, "TotalConsLen"), F.when(F.col("Remapped_Discordant") < 4, "MinDiscord"), F.lit("any"))
    return fl.reason_counts(_calls(spark, d).select(found.alias("r")), "r")


_HITS = f"""hits AS (SELECT DISTINCT o AS ins, 1 + n % 2 AS be, CASE p % 3 WHEN 0 THEN 'ALU:Y' WHEN 1 THEN 'L1:HS' ELSE 'SVA:F' END AS t, (p * 7 + s) % 60 AS sc, p % 300 AS ts, 20 + s % 80 AS ta, 400 + (p % 3) * 10 AS tz, CASE WHEN p % 4 = 0 THEN repeat('A', 40) WHEN p % 4 = 1 THEN 'ACGTACGT' || repeat('A', 10) ELSE repeat('ACGT', 8) END AS qa, 0.88::DOUBLE + (p % 12) / 100.0::DOUBLE AS pct FROM {_L}),
one AS (SELECT *, row_number() OVER (PARTITION BY ins, be, t ORDER BY sc DESC, qa, ts, ta, tz, pct) AS k FROM hits WHERE pct > 0.9), bt AS (SELECT * FROM one WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY ins, be ORDER BY sc DESC, t) AS k2 FROM bt),
i AS (SELECT DISTINCT ins FROM bt), m AS (SELECT i.ins, b1, b2, n1, n2 FROM i LEFT JOIN (SELECT ins, r AS b1 FROM r WHERE be = 1 AND k2 = 1) USING (ins) LEFT JOIN (SELECT ins, r AS b2 FROM r WHERE be = 2 AND k2 = 1) USING (ins)
LEFT JOIN (SELECT bt.ins, bt AS n1 FROM bt JOIN r ON r.ins = bt.ins AND bt.be = 1 AND r.be = 2 AND r.k2 = 1 AND r.t = bt.t) USING (ins) LEFT JOIN (SELECT bt.ins, bt AS n2 FROM bt JOIN r ON r.ins = bt.ins AND bt.be = 2 AND r.be = 1 AND r.k2 = 1 AND r.t = bt.t) USING (ins)),
s1 AS (SELECT ins, b1.t <> b2.t AS df, n1, n2, b1.sc > b2.sc AS fh, b1, b2 FROM m),
s2 AS (SELECT ins, coalesce(df, false) AS df, n1, n2, CASE WHEN df AND NOT fh AND n1.t IS NOT NULL AND b1.sc - n1.sc < CASE WHEN ins % 2 = 0 THEN 20 ELSE 5 END THEN n1.t ELSE b1.t END AS t1, CASE WHEN df AND NOT fh AND n1.t IS NOT NULL AND b1.sc - n1.sc < CASE WHEN ins % 2 = 0 THEN 20 ELSE 5 END THEN n1.sc ELSE b1.sc END AS c1, CASE WHEN df AND NOT fh AND n1.t IS NOT NULL AND b1.sc - n1.sc < CASE WHEN ins % 2 = 0 THEN 20 ELSE 5 END THEN n1.qa ELSE b1.qa END AS q1,
CASE WHEN df AND fh AND n2.t IS NOT NULL AND b2.sc - n2.sc < CASE WHEN ins % 3 = 0 THEN 20 ELSE 5 END THEN n2.t ELSE b2.t END AS t2, CASE WHEN df AND fh AND n2.t IS NOT NULL AND b2.sc - n2.sc < CASE WHEN ins % 3 = 0 THEN 20 ELSE 5 END THEN n2.sc ELSE b2.sc END AS c2, CASE WHEN df AND fh AND n2.t IS NOT NULL AND b2.sc - n2.sc < CASE WHEN ins % 3 = 0 THEN 20 ELSE 5 END THEN n2.qa ELSE b2.qa END AS q2 FROM s1),
s3 AS (SELECT ins, df, n1, n2, c1, c2, CASE WHEN t1 <> t2 AND q1 = repeat('A', 40) THEN NULL ELSE t1 END AS t1, CASE WHEN t1 <> t2 AND q2 = repeat('A', 40) THEN NULL ELSE t2 END AS t2 FROM s2),
fin AS (SELECT ins, CASE WHEN df AND t1 IS NOT NULL AND t2 IS NOT NULL AND NOT c1 > c2 THEN n1.t ELSE t1 END AS be1_target, CASE WHEN df AND t1 IS NOT NULL AND t2 IS NOT NULL AND c1 > c2 THEN n2.t ELSE t2 END AS be2_target FROM s3)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    hits = _x(spark, d).select(F.col("o").alias("ins"), e("1 + n % 2").alias("be"), e("case p % 3 when 0 then 'ALU:Y' when 1 then 'L1:HS' else 'SVA:F' end").alias("target_id"), e("(p * 7 + s) % 60").alias("score"), e("p % 300").alias("target_start"), e("20 + s % 80").alias("target_alnsize"), e("400 + (p % 3) * 10").alias("target_seqsize"), e("case p % 4 when 0 then repeat('A', 40) when 1 then concat('ACGTACGT', repeat('A', 10)) else repeat('ACGT', 8) end").alias("query_align"), F.lit("ACGT").alias("target_align"), e("0.88D + (p % 12) / 100.0D").alias("pct"))
    poly = hits.select("ins").distinct().select("ins", F.when(F.col("ins") % 2 == 0, 0.9).otherwise(0.1).alias("be1_poly"), F.when(F.col("ins") % 3 == 0, 0.9).otherwise(0.1).alias("be2_poly"))
    return rs.best_ends(hits, poly)


@query(f"WITH {_HITS} SELECT ins, coalesce(be1_target, '-') AS be1_target, coalesce(be2_target, '-') AS be2_target FROM fin")
def q81_best_ends(spark, d):
    return _best(spark, d).select("ins", F.coalesce("be1.target_id", F.lit("-")).alias("be1_target"), F.coalesce("be2.target_id", F.lit("-")).alias("be2_target"))


_TWO = f"""e AS (SELECT o * 10 + n AS id, n % 3 <> 0 AS h1, n % 3 <> 1 AS h2, CASE o % 3 WHEN 0 THEN 'ALU:Y' ELSE 'L1:HS' END AS t1, CASE p % 3 WHEN 0 THEN 'ALU:Y' ELSE 'L1:HS' END AS t2, o % 50 AS c1, p % 50 AS c2, o % 350 AS s1, p % 350 AS s2, 30 + s % 50 AS a, 400 AS z, CASE WHEN o % 5 = 0 THEN repeat('A', 30) ELSE repeat('ACGT', 6) END AS q1, CASE WHEN p % 5 = 0 THEN repeat('T', 30) WHEN p % 5 = 1 THEN 'CC' || repeat('A', 10) ELSE repeat('ACGT', 6) END AS q2, CAST(q AS BIGINT) AS pe, s % 20 AS ps FROM {_L}),
k AS (SELECT *, CASE WHEN h1 AND h2 THEN s1 > s2 WHEN h1 THEN z - s1 - a < 10 OR suffix(q1, 'AAAAAAAAAA') WHEN h2 THEN NOT (z - s2 - a < 10 OR suffix(q2, 'AAAAAAAAAA')) END AS is3 FROM e)"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr
    end = lambda x, other, q: F.struct(e(f"case {x} % 3 when 0 then 'ALU:Y' else 'L1:HS' end").alias("target_id"), e(f"{x} % 50").alias("score"), e(f"{x} % 350").alias("target_start"), e("30 + s % 50").alias("target_alnsize"), F.lit(400).alias("target_seqsize"), e(q).alias("query_align"), F.lit("C").alias("target_align"))
    one = end("o", "p", "if(o % 5 = 0, repeat('A', 30), repeat('ACGT', 6))")
    two = end("p", "o", "case p % 5 when 0 then repeat('T', 30) when 1 then concat('CC', repeat('A', 10)) else repeat('ACGT', 6) end")
    rows = _x(spark, d).select("*", (F.col("o") * 10 + F.col("n")).alias("id"), F.when(e("n % 3 <> 0"), one).alias("be1"), F.when(e("n % 3 <> 1"), two).alias("be2"))
    return rows.withColumn("is_3prime", rs.be1_is_3prime())


@query(f"""WITH {_TWO} SELECT id, is3 AS be1_is_3prime, CAST(CASE WHEN h1 AND h2 THEN greatest(s1, s2) + a - least(s1, s2) WHEN h1 AND NOT is3 THEN z - s1 WHEN h2 AND is3 THEN z - s2 ELSE -1 END AS BIGINT) AS length,
CASE WHEN h1 AND h2 THEN CASE WHEN t1 = t2 THEN t1 WHEN o5 THEN t2 WHEN p5 THEN t1 WHEN c1 > c2 THEN t1 WHEN c1 < c2 THEN t2 ELSE 'none' END WHEN h1 THEN t1 WHEN h2 THEN t2 END AS element,
CASE WHEN ((is3 = (ps > 60 - pe)) <> (n2 = 0)) THEN '+' ELSE '-' END AS orient FROM (SELECT *, q1 = repeat('A', 30) AS o5, q2 = repeat('T', 30) AS p5, a % 2 AS n2 FROM k) WHERE is3 IS NOT NULL""")
def q82_ends_and_length(spark, d):
    rows = _two(spark, d).where(F.col("is_3prime").isNotNull())
    orient = rs.orientation(F.lit("A" * 60), F.expr("s % 20"), F.col("q"), F.when(F.expr("(30 + s % 50) % 2 = 0"), "-").otherwise("+"), F.col("is_3prime"))
    return rows.select("id", F.col("is_3prime").alias("be1_is_3prime"), F.coalesce(rs.insertion_length(), F.lit(-1)).cast("long").alias("length"), F.coalesce(rs.best_element(), F.lit("none")).alias("element"), orient.alias("orient"))


@query(f"""WITH t AS (SELECT *, o * 10 + n AS uuid, CASE WHEN n % 4 = 0 THEN NULL ELSE o % 2 = 0 END AS is3 FROM {_L}), u AS (SELECT *, CASE WHEN is3 THEN p % 90 ELSE o % 90 END AS fs, CASE WHEN is3 THEN o % 90 + 200 ELSE p % 90 + 200 END AS te, CASE WHEN is3 THEN p % 6 ELSE o % 6 END AS sr5, CASE WHEN is3 THEN o % 6 ELSE p % 6 END AS sr3 FROM t)
SELECT uuid AS "UUID", CASE WHEN is3 THEN 'be2' WHEN NOT is3 THEN 'be1' END AS "5_Prime_End", 'L1' AS "Superfamily", CASE WHEN p % 2 = 0 THEN 'HS' END AS "Subfamily", CASE WHEN is3 IS NULL THEN q ELSE least(fs, q) END AS "TE_Align_Start", CASE WHEN is3 IS NULL THEN q + 150 ELSE greatest(te, q + 150) END AS "TE_Align_End",
CASE WHEN is3 IS NULL THEN NULL WHEN o % 3 = p % 3 THEN 'N' ELSE 'Y' END AS "Inversion", CASE WHEN is3 IS NULL THEN 0 ELSE sr5 END AS "Split_reads_5prime", round(q / 40.0::DOUBLE, 6) AS "Remap_Disc_Fraction", CASE WHEN is3 IS NULL THEN 0 ELSE round(coalesce(q / nullif(sr5 + sr3, 0)::DOUBLE, 0), 6) END AS "Remap_Split_Fraction", CASE WHEN is3 IS NULL THEN 0 WHEN o % 2 = p % 2 THEN 2 ELSE 3 END AS "Sample_count" FROM u""")
def q83_result_table(spark, d):
    e = F.expr
    end = lambda x: F.struct(F.lit(0.9).alias("pct"), F.lit(0.99).alias("avg_match"), F.lit(100).alias("cons_len"), e(f"{x} % 6").alias("sr"), e(f"{x} % 90").alias("start"), e(f"{x} % 90 + 200").alias("end"), e(f"cast({x} % 3 as string)").alias("orient"), F.array(e(f"concat('b', {x} % 2, '|2')"), F.lit("x|1")).alias("samples"))
    calls = _x(spark, d).select((F.col("o") * 10 + F.col("n")).alias("uuid"), F.lit("c").alias("chrom"), F.lit(1).alias("low"), F.lit(9).alias("high"), e("if(n % 4 = 0, null, o % 2 = 0)").alias("be1_is_3prime"), e("if(p % 2 = 0, 'L1:HS', 'L1')").alias("element"), end("o").alias("end1"), end("p").alias("end2"), F.col("q").alias("remap_min"), (F.col("q") + 150).alias("remap_max"), F.col("q").alias("remap_dr"), F.lit(40).alias("dr"), F.col("q").alias("remap_sr"))
    out = rs.result_table(calls)
    return out.select("UUID", "5_Prime_End", "Superfamily", "Subfamily", "TE_Align_Start", "TE_Align_End", "Inversion", "Split_reads_5prime", F.round("Remap_Disc_Fraction", 6).alias("Remap_Disc_Fraction"), F.round("Remap_Split_Fraction", 6).alias("Remap_Split_Fraction"), "Sample_count")


@query(f"""WITH {_COUNTS}, v AS (SELECT site, sc, low, bam, alt + ref AS dp, coalesce(alt / nullif(alt + ref, 0)::DOUBLE, 0) AS vaf FROM cn JOIN sites USING (site)), w AS (SELECT *, CASE WHEN dp < 2 THEN 0 ELSE 2 * vaf END AS ds FROM v)
SELECT sc AS chrom, low AS pos, site AS id, 'SVTYPE=INS;ME=L1' AS info, bam, CASE WHEN dp < 2 THEN './.' WHEN ds > 0.3 AND ds < 1.7 THEN '0/1' WHEN ds < 0.3 THEN '0/0' ELSE '1/1' END || ':' || printf('%.3f', ds) AS value FROM w""")
def q84_vcf_calls(spark, d):
    sites = _sites(spark, d).select("site", F.col("site_chrom").alias("chrom"), F.col("low").alias("pos"), F.lit("L1").alias("element"))
    return rs.vcf_calls(sites, be.break_counts(_reads(spark, d), _sites(spark, d)), least_depth=2)


@query(f"""WITH c AS (SELECT o, n, p, s, q FROM {_L}) SELECT o * 10 + n AS uuid, round((p % 7 + o % 7) / greatest(q % 3, 1)::DOUBLE, 6) AS f_split, CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END AS f_inverted, CASE WHEN o % 2 = 0 THEN 5 ELSE 4 END AS f_tsd_length, levenshtein(CASE WHEN o % 2 = 0 THEN 'ACGTT' ELSE '' END, 'ACGA') AS f_tsd_distance,
CASE WHEN o % 2 = 0 THEN 4 ELSE 0 END AS f_tsd_bases, round(greatest((s % 10) / 10.0::DOUBLE, 0.25), 6) AS f_max_vaf, greatest(p % 30 + 1, 7)::DOUBLE AS f_max_depth FROM c""")
def q85_features(spark, d):
    e = F.expr
    calls = _x(spark, d).select((F.col("o") * 10 + F.col("n")).alias("uuid"), e("p % 7").alias("Split_reads_5prime"), e("o % 7").alias("Split_reads_3prime"), F.col("q").alias("Remapped_Discordant"), e("q % 3").alias("Sample_count"), e("if(p % 2 = 0, 'Y', 'N')").alias("Inversion"), e("if(o % 2 = 0, 'ACGTT', null)").alias("TSD_5prime"), F.lit("ACGA").alias("TSD_3prime"), F.lit(1).alias("TE_Align_Start"), F.lit(9).alias("TE_Align_End"), e("concat('b|1|', p % 30, '|', cast((s % 10) / 10.0D as string), ',c|3|4|0.25')").alias("genotypes"))
    return rs.features(calls).select("uuid", F.round("f_split", 6).alias("f_split"), F.col("f_inverted"), F.col("f_tsd_length"), F.col("f_tsd_distance"), F.col("f_tsd_bases"), F.round("f_max_vaf", 6).alias("f_max_vaf"), "f_max_depth")


@query(f"WITH h AS (SELECT o, p % 500 AS st, p % 500 + 50 AS en, CASE WHEN n % 2 = 0 THEN 'DR' ELSE 'SR' END AS kind FROM {_L}) SELECT o, min(st) AS remap_min, max(en) AS remap_max, count(*) FILTER (kind = 'DR') AS remap_dr, count(*) FILTER (kind = 'SR') AS remap_sr FROM h GROUP BY 1")
def q86_remap_counts(spark, d):
    hits = _x(spark, d).select("o", F.expr("concat('r.', p, if(n % 2 = 0, '.DR', '.SR'))").alias("qname"), F.expr("p % 500").alias("start"), F.expr("p % 500 + 50").alias("end"))
    return rs.remap_counts(hits, ["o"])


@query(f"""WITH c AS (SELECT o * 10 + n AS id, upper(CASE WHEN p % 2 = 0 THEN 'cc' || repeat('a', CAST(p % 9 AS INT)) || 'g' || repeat('A', CAST(o % 9 AS INT)) ELSE 'GT' END) AS x, o % 40 AS l, p % 40 AS m, s FROM {_L})
SELECT id, CASE WHEN strpos(x, 'A') = 0 THEN 0 ELSE CASE WHEN length(split_part(x, 'G', 1)) - 2 >= length(split_part(x, 'G', 2)) THEN 2 ELSE length(split_part(x, 'G', 1)) + 1 END END AS run_start, CASE WHEN strpos(x, 'A') = 0 THEN 0 ELSE greatest(length(split_part(x, 'G', 1)) - 2, length(split_part(x, 'G', 2))) - 1 END AS run, least(l, m) AS walk, CASE WHEN l >= 20 THEN '+' WHEN m >= 20 THEN '-' ELSE 'none' END AS tail, greatest(l, 0) AS uncovered FROM c""")
def q87_sequence_scans(spark, d):
    e = F.expr
    rows = _x(spark, d).select((F.col("o") * 10 + F.col("n")).alias("id"), e("if(p % 2 = 0, concat('cc', repeat('a', cast(p % 9 as int)), 'g', repeat('A', cast(o % 9 as int))), 'GT')").alias("x"), e("cast(o % 40 as int)").alias("l"), e("cast(p % 40 as int)").alias("m"))
    scan = sq.run_scan(F.col("x"), "A")
    walk = sq.common_walk(F.concat(F.call_function("repeat", F.lit("A"), F.col("l")), F.lit("C")), F.concat(F.call_function("repeat", F.lit("a"), F.col("m")), F.lit("G")))
    tail = sq.tail_strand(F.concat(F.call_function("repeat", F.lit("t"), F.col("m")), F.lit("C"), F.call_function("repeat", F.lit("a"), F.col("l"))))
    open_ = F.aggregate(sq.uncovered(F.lit(100), F.array(F.struct((F.col("l") + 20).alias("start"), F.lit(100).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(20).alias("end")))), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return rows.select("id", scan["start"].cast("long").alias("run_start"), scan["run"].cast("long").alias("run"), walk.cast("long").alias("walk"), F.coalesce(tail, F.lit("none")).alias("tail"), open_.cast("long").alias("uncovered"))


_STRANDS = "(SELECT user_id, event_id, event_type IN ('click', 'view') AS a, event_id % 3 = 0 AS b FROM events)"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS j FROM {_STRANDS}), h AS (SELECT user_id, max(a::INT) FILTER (i = 1) = 1 AS a0, max(b::INT) FILTER (i = 1) = 1 AS b0, max((a = b)::INT) FILTER (i = 1) = 1 AS f, max((a = b)::INT) FILTER (j = 1) = 1 AS l FROM r GROUP BY 1),
m AS (SELECT r.user_id, min(i) FILTER (a <> a0) AS af, max(i) FILTER (a = a0) AS al, min(i) FILTER (b <> b0) AS bf, max(i) FILTER (b = b0) AS bl FROM r JOIN h USING (user_id) GROUP BY 1)
SELECT user_id, CASE WHEN f AND l THEN '-' WHEN NOT f AND NOT l THEN '+' ELSE 'NA' END AS strand, coalesce(af > al AND bf > bl, false) AS switches, coalesce(af > al AND bf > bl AND af = bf, false) AS together FROM h JOIN m USING (user_id)""")
def q88_strands(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("a"), (F.col("event_id") % 3 == 0).alias("b"))
    return cl.strand_of(e, ["user_id"], ["event_id"], "a", "b").join(cl.strand_switch(e, ["user_id"], ["event_id"], "a", "b"), "user_id")


@query(f"WITH {_CALLS}, {_ELTS} SELECT low AS start, high AS end, 'c' || 0 || bs AS uuid FROM (SELECT DISTINCT chrom, low, high FROM calls) JOIN elts ON chrom = b_chrom AND low < be AND high > bs")
def q89_replace_ids(spark, d):
    spans = _calls(spark, d).select(F.col("Chromosome").alias("chrom"), F.col("Left_Extreme").alias("start"), F.col("Right_Extreme").alias("end"), F.lit("old").alias("uuid")).dropDuplicates(["chrom", "start", "end"])
    ids = _elements(spark, d).select("b_chrom", "b_start", "b_end", F.concat(F.lit("c0"), F.col("b_start").cast("string")).alias("b_uuid"))
    return iv.replace_ids(spans, ids, "uuid", 1024).select("start", "end", "uuid")


@query(f"WITH {_CALLS} SELECT DISTINCT a.uuid FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.chrom = a.chrom AND b.low < a.high + 500 AND b.high > a.low - 500 AND b.sr5 + b.sr3 > a.sr5 + a.sr3)")
def q90_decluster_spans(spark, d):
    calls = _calls(spark, d).select("UUID", F.col("Chromosome").alias("chrom"), F.col("Left_Extreme").alias("start"), F.col("Right_Extreme").alias("end"), (F.col("Split_reads_5prime") + F.col("Split_reads_3prime")).alias("v"))
    return iv.decluster_spans(calls, "v", 500, 1024).select(F.col("UUID").alias("uuid")).distinct()


@query("WITH c AS (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) SELECT user_id, event_type, event_id FROM c WHERE n <= 20 OR r <= floor(k / n::DOUBLE * 20)")
def q91_proportional_cap(spark, d):
    return ev.proportional_cap(_t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", [F.asc("event_id")], 20)


@query(f"""WITH r AS (SELECT s % 4 AS c, p % 400 AS pos, CASE WHEN p % 400 % 3 = 0 THEN 'ACTT' ELSE 'ACGT' END AS seq FROM {_L} WHERE q % 5 <> 0), b AS (SELECT c, pos + i AS pos, seq[i + 1] AS base, 'ACGT'[i + 1] AS was FROM r, range(4) x(i)), k AS (SELECT c, pos, was, base, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY c, pos) AS depth, row_number() OVER (PARTITION BY c, pos ORDER BY n DESC, base, was) AS z FROM k) SELECT c AS chrom, pos, was, base AS alt, n, CAST(depth AS BIGINT) AS depth FROM t WHERE z = 1 AND base <> was AND n >= 2 AND n >= 0.3 * depth""")
def q92_base_calls(spark, d):
    r = _x(spark, d).select(F.expr("s % 4").alias("chrom"), F.expr("p % 400").alias("pos"), F.expr("if(p % 400 % 3 = 0, 'actt', 'ACGT')").alias("seq"), F.lit("ACGT").alias("ref"), F.expr("if(q % 5 = 0, '2S2M', '4M')").alias("cigar"))
    return rd.base_calls(r, 2, 0.3)


@query()
def q50_isolation(spark, d):
    """Outliers of each family by an isolation forest. No SQL: trees are random; a test plants outliers and compares path lengths."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("family"), *[F.col(x).cast("double").alias(x) for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return outliers.isolation(rows, "family", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "family", F.round("outlier_score", 6).alias("outlier_score"), "outlier")
