"""Queries of BAM files, walks over CIGARs, alignment to a genome and assembly, on reads and contigs that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequence import reverse_complement
from strandloom.operators import assembly, chimeras, filters, mapping, orientation, pairing
from strandloom.operators import reads as rd
from strandloom.operators.lineage import fresh_folder, written
from strandloom.sources import alignments as al
from strandloom.sources import bam

from .read_queries import _READS, _SITES, _reads, _sites, _x
from .registry import _t, query

_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


def _bases(key: str) -> Column:
    """128 letters that a key decides: of 'n' and 'm' before it."""
    return F.translate(F.concat(F.sha2(F.expr(f"concat('n', {key})"), 256), F.sha2(F.expr(f"concat('m', {key})"), 256)), "0123456789abcdef", "ACGTACGTACGTACGT")


def _sql_bases(key: str) -> str:
    return f"translate(sha256('n' || {key}) || sha256('m' || {key}), {_HEX})"


@query(f"WITH {_READS} SELECT qname, CAST(n AS INT) AS nm, pos, CAST(mapq AS INT) AS mapq, alen::BIGINT AS alen, mate_chrom, mate_pos FROM reads WHERE chrom = 'c1' AND pos < 400000 AND ref_end > 200000")
def q106_bam_region(spark, d):
    """Reads written to sorted, indexed BAM files, and those of a region read again through the indexes."""
    folder = fresh_folder(spark, "bam")
    reads = _reads(spark, d).withColumn("tags", F.create_map(F.lit("NM"), F.col("nm").cast("string")))
    contigs = reads.groupBy("chrom").agg((F.max("ref_end") + 1).cast("int").alias("length"))
    bam.write_bam(reads, contigs, folder)
    found = rd.with_alignment(bam.read_bam(spark, folder, "c1:200000-400000"))
    return found.select("qname", "nm", "pos", "mapq", F.col("alen").cast("long").alias("alen"), "mate_chrom", "mate_pos")


def _genome(spark: SparkSession, d: str) -> DataFrame:
    """Five contigs, each of the parts' letters in their order."""
    laid = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "s"))), lambda x: x["s"]), "")
    return _t(spark, d, "part").select("p_partkey", _bases("p_partkey").alias("s")).groupBy(F.concat(F.lit("g"), (F.col("p_partkey") % 5).cast("string")).alias("chrom")).agg(laid.alias("seq"))


_GENOME = "WITH g AS (SELECT p_partkey % 5 AS k, count(*) * 128 AS n FROM part GROUP BY 1), o AS (SELECT o_orderkey AS o, 'g' || k AS chrom, (o_orderkey * 7919) % (n - 100) AS pos FROM orders JOIN g ON o_orderkey % 5 = k)"


def _pieces(spark: SparkSession, d: str, genome: DataFrame) -> DataFrame:
    """Orders as reads of 100 letters of the genome: every third on the other strand, every second with a letter changed."""
    sizes = genome.select("chrom", F.length("seq").alias("n"))
    spans = _t(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.concat(F.lit("g"), (F.col("o_orderkey") % 5).cast("string")).alias("chrom")).join(F.broadcast(sizes), "chrom").withColumn("start", (F.col("o") * 7919) % (F.col("n") - 100)).withColumn("end", F.col("start") + 100)
    found = al.fetch(spans, al.tiles(genome, 4096), ["o"], 4096)
    changed = F.when(F.col("o") % 2 == 0, F.concat(F.substring("seq", 1, 50), F.translate(F.substring("seq", 51, 1), "ACGT", "CGTA"), F.substring("seq", 52, 49))).otherwise(F.col("seq"))
    return found.select(F.col("o").alias("query_id"), changed.alias("seq")).select("query_id", F.when(F.col("query_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


@query(f"""{_GENOME} SELECT o AS query_id, chrom, pos, CASE WHEN o % 3 = 0 THEN '-' ELSE '+' END AS strand, '100M' AS cigar, CAST(CASE WHEN o % 2 = 0 THEN 95 ELSE 100 END AS BIGINT) AS score, CAST(CASE WHEN o % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS nm,
CAST(0 AS BIGINT) AS q_start, CAST(100 AS BIGINT) AS q_end FROM o""")
def q107_genome_alignment(spark, d):
    genome = written(_genome(spark, d))
    return mapping.aligned(written(_pieces(spark, d, genome)), genome).where("part = 0").select("query_id", "chrom", "pos", "strand", "cigar", "score", "nm", "q_start", "q_end")


@query(f"""WITH {_SITES}, r AS (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, 'c' || (l_suppkey % 5) AS chrom, 1000 + (l_partkey * 9973 + l_orderkey * 31) % 1000000 AS pos FROM lineitem),
m AS (SELECT site, count(*) AS n FROM sites JOIN r ON chrom = sc AND pos < high + 500 AND pos + 60 > low - 500 WHERE p % 3 < 2 GROUP BY 1) SELECT site, coalesce(n, 0) AS n FROM sites LEFT JOIN m USING (site)""")
def q108_realigned_counts(spark, d):
    """Clipped parts of 25 letters: of an element of the library, of A, or of no sequence that is known."""
    e = F.expr
    rows = _x(spark, d).select(e("concat('c', s % 5)").alias("chrom"), e("1000 + (p * 9973 + o * 31) % 1000000").alias("pos"), "o", "n", "p")
    part = F.when(e("p % 3 = 0"), F.substring(_bases("o % 25"), e("cast(o % 100 + 1 as int)"), F.lit(25))).when(e("p % 3 = 1"), F.lit("A" * 25)).otherwise(F.substring(_bases("concat(o, '-', n)"), 1, 25))
    reads = rd.with_alignment(rows.withColumns({"cigar": F.lit("60M25S"), "seq": F.concat(F.substring(_bases("concat('q', o)"), 1, 60), part), "nm": F.lit(0)}))
    library = _t(spark, d, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("chrom"), _bases("n_nationkey").alias("seq"))
    spans = _sites(spark, d).select(F.col("site").alias("span_id"), F.col("site_chrom").alias("chrom"), (F.col("low") - 500).alias("start"), (F.col("high") + 500).alias("end"))
    return mapping.realigned_counts(spans, reads, library).withColumnRenamed("span_id", "site")


@query(f"""WITH j AS (SELECT p_partkey AS p, 1000 + p_partkey AS pos, p_partkey % 5 = 0 AS gap, p_partkey % 12 AS shared, {_sql_bases('p_partkey')} AS s FROM part),
k AS (SELECT *, pos + 29 + CASE WHEN gap THEN 2 ELSE 0 END AS last FROM j), t AS (SELECT *, last - shared + 1 AS start, last + 1 AS stop FROM k WHERE shared >= 2)
SELECT p AS site, start, stop, substr(s, 31 - shared, shared) AS tsd_left, substr(s, 51, shared) AS tsd_right FROM t""")
def q109_target_sites(spark, d):
    """Two junctions of each site, of which the first has a gap in every fifth: the stretch that both cover, and its letters in each."""
    e = F.expr
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") + 1000).alias("pos"), _bases("p_partkey").alias("s"))
    one = F.struct(F.col("pos"), e("if(p % 5 = 0, '15M2D15M10S', '30M10S')").alias("cigar"), F.substring("s", 1, 40).alias("seq"))
    two = F.struct(e("pos + 30 + if(p % 5 = 0, 2, 0) - p % 12").alias("pos"), F.lit("10S30M").alias("cigar"), F.substring("s", 41, 40).alias("seq"))
    site = cg.target_site(one, two, exact=True)
    return rows.select("p", site.alias("t")).where("t is not null").select(F.col("p").alias("site"), F.col("t.start").alias("start"), F.col("t.end").alias("stop"), F.col("t.first").alias("tsd_left"), F.col("t.second").alias("tsd_right"))


@query("""WITH r AS (SELECT l_suppkey % 4 AS c, l_partkey % 400 AS pos, CASE WHEN l_partkey % 400 % 3 = 0 THEN 'ACTT' ELSE 'ACGT' END AS seq, l_quantity::BIGINT % 5 AS k FROM lineitem),
b AS (SELECT c, pos + i AS pos, CASE WHEN k = 0 THEN seq[i + 3] WHEN k = 1 THEN CASE WHEN i = 0 THEN seq[1] ELSE seq[i + 2] END WHEN k = 2 THEN seq[CASE WHEN i < 2 THEN i + 1 ELSE i END] ELSE seq[i + 1] END AS base, 'ACGTA'[i + 1] AS was
FROM r, range(5) x(i) WHERE CASE WHEN k = 0 THEN i < 2 WHEN k = 1 THEN i < 2 WHEN k = 2 THEN i <> 2 ELSE i < 4 END),
n AS (SELECT c, pos, was, base, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY c, pos) AS depth, row_number() OVER (PARTITION BY c, pos ORDER BY n DESC, base, was) AS z FROM n)
SELECT c AS chrom, pos, was, base AS alt, n, CAST(depth AS BIGINT) AS depth FROM t WHERE z = 1 AND base <> was AND n >= 2 AND n >= 0.3 * depth""")
def q110_gapped_base_calls(spark, d):
    """Bases of clipped, inserted, deleted and plain reads."""
    cigar = F.expr("case q % 5 when 0 then '2S2M' when 1 then '1M1I1M1S' when 2 then '2M1D2M' else '4M' end")
    r = _x(spark, d).select(F.expr("s % 4").alias("chrom"), F.expr("p % 400").alias("pos"), F.expr("if(p % 400 % 3 = 0, 'actt', 'ACGT')").alias("seq"), F.lit("ACGTA").alias("ref"), cigar.alias("cigar"))
    return rd.base_calls(r, 2, 0.3, gapped=True)


@query(f"""WITH o AS (SELECT DISTINCT c_nationkey AS k, o_orderkey % 60 AS off FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY k ORDER BY off) <= 39 THEN 0 ELSE 1 END AS nw FROM o),
i AS (SELECT k, min(off) AS low, max(off) AS high FROM (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY off) AS isle FROM g) GROUP BY k, isle), s AS (SELECT k, substr({_sql_bases('k')}, low + 1, high - low + 60) AS c FROM i)
SELECT k AS nation, least(c, reverse(translate(c, 'ACGT', 'TGCA'))) AS contig, length(c) - 20 AS n_words FROM s""")
def q111_unitigs(spark, d):
    """Orders as pieces of their nation's sequence, every third on the other strand, put together again."""
    c = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"))
    piece = F.substring(_bases("nation"), F.expr("cast(o_orderkey % 60 + 1 as int)"), F.lit(60))
    reads = c.select("nation", F.when(F.col("o_orderkey") % 3 == 0, reverse_complement(piece)).otherwise(piece).alias("seq"))
    return assembly.unitigs(assembly.words(reads, ["nation"], 21), ["nation"], 21).select("nation", "contig", "n_words")


def _oriented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as calls whose ends are pieces of their element and of their site, each on a strand of its own; some genomic consensuses, and some of both kinds, hold no element. N between pieces keep alignments from running on."""
    e = F.expr
    turned = lambda s, test: F.when(e(test), reverse_complement(s)).otherwise(s)
    element, site = _bases("p % 25"), _bases("concat('s', p)")
    piece = lambda at: F.substring(element, e(f"cast({at} * 40 + 1 as int)"), F.lit(40))
    five = F.concat(turned(piece("p % 3"), "p % 2 = 1"), F.lit("N" * 15), turned(F.substring(site, 21, 40), "p % 5 = 0"))
    three = F.concat(turned(piece("((p % 3 + 1 + p div 3 % 2) % 3)"), "p div 2 % 2 = 1"), F.lit("N" * 15), turned(F.substring(site, 61, 40), "p % 7 = 0"))
    nothing = _bases("concat('x', p)")
    calls = _t(spark, d, "part").select(F.col("p_partkey").alias("p")).select(
        F.col("p").alias("UUID"), F.concat(F.lit("e"), e("p % 25").cast("string")).alias("element"), site.alias("site_seq"), F.lit("?").alias("Orient_5p"), F.lit("?").alias("Orient_3p"), F.lit("?").alias("Inversion"), F.lit("be1").alias("5_Prime_End"), F.lit("be2").alias("3_Prime_End"),
        F.when(e("p % 11 = 0 or p % 13 = 0"), nothing).otherwise(five).alias("Genomic_Consensus_5p"), three.alias("Genomic_Consensus_3p"), F.when(e("p % 13 = 0"), nothing).otherwise(five).alias("Insert_Consensus_5p"), F.lit("").alias("Insert_Consensus_3p"),
    )
    return calls, _t(spark, d, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("element"), _bases("n_nationkey").alias("element_seq"))


@query("""WITH c AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 13 = 0 THEN 'NA' WHEN (p_partkey % 2 = 1) = (p_partkey % 5 = 0) THEN '+' ELSE '-' END AS o5, CASE WHEN ((p_partkey // 2) % 2 = 1) = (p_partkey % 7 = 0) THEN '+' ELSE '-' END AS o3 FROM part),
f AS (SELECT *, p % 13 <> 0 AND p % 3 > (p % 3 + 1 + (p // 3) % 2) % 3 AS flip, p % 17 > 0 AS passed FROM c)
SELECT p AS "UUID", CASE WHEN NOT passed THEN '?' WHEN flip THEN o3 ELSE o5 END AS "Orient_5p", CASE WHEN NOT passed THEN '?' WHEN flip THEN o5 ELSE o3 END AS "Orient_3p", CASE WHEN NOT passed THEN '?' WHEN o5 <> 'NA' AND o5 <> o3 THEN 'Y' ELSE 'N' END AS "Inversion",
CASE WHEN passed AND flip THEN 'be2' ELSE 'be1' END AS "5_Prime_End", CASE WHEN passed AND flip THEN 'be1' ELSE 'be2' END AS "3_Prime_End" FROM f""")
def q112_orientation_repair(spark, d):
    calls, elements = _oriented(spark, d)
    done = orientation.repaired(calls, elements, F.col("UUID") % 17 > 0)
    return done.select("UUID", "Orient_5p", "Orient_3p", "Inversion", "5_Prime_End", "3_Prime_End")


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Parts as calls in the order of their keys, many of which share breakpoints."""
    e = F.expr
    return _t(spark, d, "part").select(F.col("p_partkey").alias("n")).select("n", e("concat('c', n % 5)").alias("chrom"), e("n * 37 % (1000 + n div 3)").alias("be1"), e("n * 37 % (1000 + n div 3) + if(n % 3 = 0, 0, n % 7)").alias("be2"), e("n % 11").alias("sr"), e("n % 4").alias("dr"))


@query()
def q113_resolved_duplicates(spark, d):
    """One call of those that share breakpoints. No SQL: which one depends on the order of the list; a test compares it with a loop."""
    return pairing.resolved_duplicates(_repeated(spark, d), "n")


@query("SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 4 <> 1")
def q114_screened(spark, d):
    """Orders as sequences, of which every fourth stands nowhere in the genome."""
    genome = written(_genome(spark, d))
    rows = _pieces(spark, d, genome).withColumn("seq", F.when(F.col("query_id") % 4 == 1, F.substring(_bases("concat('z', query_id)"), 1, 100)).otherwise(F.col("seq")))
    return filters.screened(written(rows), "query_id", "seq", genome).select("query_id")


@query(f"""WITH c AS (SELECT p_partkey AS p, p_partkey % 40 AS h, 'c' || (p_partkey % 5) AS chrom, (p_partkey * 7919) % 1000000 AS low, ['L1', 'ALU', 'OTHER'][p_partkey % 3 + 1] AS fam FROM part),
m AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'L1' ELSE 'ALU' END AS fam, 'c' || ((s_suppkey // 2) % 4) AS chrom, (s_suppkey * 997) % 1000000 AS s, (s_suppkey * 997) % 1000000 + 300 AS e FROM supplier)
SELECT p AS "UUID", h::INTEGER AS "ChimeraBaseCount", CASE WHEN h >= 20 THEN 100.0 ELSE 0.0 END::DOUBLE AS "ChimeraMatchIns", CASE WHEN h >= 20 THEN 100.0 ELSE 0.0 END::DOUBLE AS "ChimeraMatchRef", CASE WHEN h = 0 THEN 'NA' ELSE substr({_sql_bases("('h' || p)")}, 1, h::INTEGER) END AS "InsSiteHomology",
fam <> 'OTHER' AND (EXISTS (SELECT 1 FROM m WHERE m.fam = c.fam AND m.chrom = c.chrom AND m.s < c.low + 10005 AND m.e > greatest(c.low - 10000, 0)) OR NOT EXISTS (SELECT 1 FROM m WHERE m.fam = c.fam AND m.chrom = c.chrom)) AS "PossibleRefEltChimera" FROM c""")
def q115_chimeras(spark, d):
    """Parts as calls whose consensus runs from the site's letters over some that both have into the element's."""
    e = F.expr
    shared = F.substring(_bases("concat('h', p)"), F.lit(1), e("cast(p % 40 as int)"))
    site, rest = F.substring(_bases("concat('s', p)"), 1, 60), F.substring(_bases("concat('t', p)"), 1, 60)
    whole = F.concat(site, shared, rest)
    calls = _t(spark, d, "part").select(F.col("p_partkey").alias("p")).select(
        F.col("p").alias("UUID"), F.concat(F.lit("e"), e("string(p)")).alias("element"), e("element_at(array('L1', 'ALU', 'OTHER'), cast(p % 3 + 1 as int))").alias("superfamily"), e("concat('c', p % 5)").alias("chrom"), e("(p * 7919) % 1000000").alias("start"), e("(p * 7919) % 1000000 + 5").alias("end"),
        F.concat(site, shared).alias("ref_seq"), F.when(e("p % 4 = 0"), "NA").otherwise(whole).alias("Genomic_Consensus_3p"), F.when(e("p % 4 = 0"), whole).otherwise("NA").alias("Genomic_Consensus_5p"),
    )
    elements = _t(spark, d, "part").select(F.col("p_partkey").alias("p")).select(F.concat(F.lit("e"), e("string(p)")).alias("element"), F.concat(shared, rest).alias("element_seq"))
    masks = _t(spark, d, "supplier").select(F.expr("if(s_suppkey % 2 = 0, 'L1', 'ALU')").alias("superfamily"), F.expr("concat('c', s_suppkey div 2 % 4)").alias("chrom"), F.expr("(s_suppkey * 997) % 1000000").alias("start"), F.expr("(s_suppkey * 997) % 1000000 + 300").alias("end"))
    done = chimeras.annotated(calls, elements, masks)
    return done.select("UUID", "ChimeraBaseCount", "ChimeraMatchIns", "ChimeraMatchRef", "InsSiteHomology", "PossibleRefEltChimera")
