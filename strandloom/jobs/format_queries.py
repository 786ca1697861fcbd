"""Queries of consensus, alignments to a library, and lines of other tools, on lines that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement
from strandloom.operators import consensus as cs
from strandloom.operators import reads as rd
from strandloom.sources import alignments as al
from strandloom.sources import texts as tx

from .registry import _t, query


def _bases(key: str) -> Column:
    """128 letters that a key decides."""
    return F.translate(F.sha2(F.expr(key), 512), "0123456789abcdef", "ACGTACGTACGTACGT")


def _overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Line items as reads of 60 bases, 8 apart, of their order's sequence; some with another letter, some of low quality at the end."""
    e = F.expr
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"))
    seq = F.substring(_bases("concat('t', o)"), e("n * 8 - 7"), F.lit(60))
    return rows.select("o", "n", F.when(e("p % 4 = 0"), F.concat(F.substring(seq, 1, 19), F.lit("N"), F.substring(seq, 21, 40))).otherwise(seq).alias("seq"), e("if(p % 5 = 0, concat(repeat('I', 50), repeat('!', 10)), repeat('I', 60))").alias("qual"))


@query()
def q93_consensus(spark, d):
    """Consensus of each order's reads. No SQL: it grows by alignments; tests compare it with a plain one and the alignment with a table filled cell by cell."""
    reads = _overlapping(spark, d).withColumn("seq", cs.trimmed(F.col("seq"), F.col("qual")))
    return cs.consensus(reads, ["o"], ["n"]).withColumn("score", F.round("score", 6))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pieces of their nation's sequence, every third on the other strand, with a changed letter."""
    c = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    piece = F.substring(_bases("concat('n', c_nationkey)"), F.expr("cast(o_orderkey % 60 + 1 as int)"), F.lit(60))
    changed = F.concat(F.substring(piece, 1, 30), F.translate(F.substring(piece, 31, 1), "ACGT", "CGTA"), F.substring(piece, 32, 29))
    return c.select(F.col("o_orderkey").alias("query_id"), "c_nationkey", F.when(F.col("o_orderkey") % 3 == 0, reverse_complement(changed)).otherwise(changed).alias("seq"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("target_id"), _bases("concat('n', n_nationkey)").alias("seq"))


_PIECES = "WITH c AS (SELECT o_orderkey AS o, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)"
#: Both scores leave the same stretch: 60 bases of which the 31st differs.
_HIT = "CASE WHEN o % 3 = 0 THEN '-' ELSE '+' END AS strand, CAST({score} AS BIGINT) AS score, CAST(0 AS BIGINT) AS query_start, CAST(60 AS BIGINT) AS query_end, o % 60 AS target_start, o % 60 + 60 AS target_end, round(59 / 60.0::DOUBLE, 6) AS identity"


@query(f"{_PIECES} SELECT o AS query_id, n AS target_id, {_HIT.format(score=115)} FROM c")
def q94_library_hits(spark, d):
    return cs.library_hits(_pieces(spark, d).select("query_id", "seq"), _library(spark, d), least=60).withColumn("identity", F.round("identity", 6))


@query(f"{_PIECES} SELECT o AS query_id, n AS target_id, {_HIT.format(score=291)} FROM c")
def q95_ungapped_hits(spark, d):
    pairs = _pieces(spark, d).join(_library(spark, d).withColumnRenamed("seq", "target"), F.col("c_nationkey") == F.col("target_id"))
    return cs.ungapped_best(pairs.select("query_id", "target_id", "seq", "target"), "seq", "target").drop("seq", "target").withColumn("identity", F.round("identity", 6))


@query("""SELECT 'r' || l_orderkey AS qname, CAST(l_linenumber AS INT) AS flag, CASE WHEN l_partkey % 9 > 0 THEN 'c' || (l_suppkey % 5) END AS chrom, l_partkey - 1 AS pos, CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_partkey % 9 > 0 THEN 'c' || (l_suppkey % 5) END ELSE 'm' END AS mate_chrom, CASE WHEN l_partkey % 3 = 0 THEN 'g' || l_suppkey END AS rg, CAST(l_linenumber AS INT) AS nm, l_partkey - 1 + 40 AS ref_end
FROM lineitem WHERE l_partkey - 1 < 1000 AND l_partkey + 39 > 50 AND l_partkey > 1""")
def q96_sam_reads(spark, d):
    e = F.expr
    fields = ["concat('r', l_orderkey)", "string(int(l_linenumber))", "if(l_partkey % 9 > 0, concat('c', l_suppkey % 5), '*')", "string(l_partkey)", "'60'", "'5S40M'", "if(l_partkey % 2 = 0, '=', 'm')", "'7'", "'0'", "'*'", "'*'", "concat('NM:i:', int(l_linenumber))", "if(l_partkey % 3 = 0, concat('RG:Z:g', l_suppkey), 'XX:Z:a:b')"]
    lines = _t(spark, d, "lineitem").select(F.when(F.col("l_partkey") == 1, "@HD\tVN:1.6").otherwise(F.concat_ws("\t", *[e(f) for f in fields])).alias("value"))
    return al.in_region(rd.with_alignment(al.sam_reads(lines)), None, 50, 1000).select("qname", "flag", "chrom", "pos", "mate_chrom", "rg", "nm", "ref_end")


@query("""SELECT doc_id, doc_id % 997 AS start, substr(text, doc_id % 997 + 1, doc_id % 301) AS seq FROM documents WHERE length(substr(text, doc_id % 997 + 1, doc_id % 301)) > 0""")
def q97_fetch(spark, d):
    docs = _t(spark, d, "documents")
    spans = docs.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), (F.col("doc_id") % 997).alias("start"), (F.col("doc_id") % 997 + F.col("doc_id") % 301).alias("end"))
    tiled = al.tiles(docs.select(F.col("doc_id").cast("string").alias("chrom"), F.col("text").alias("seq")), 256)
    return al.fetch(spans, tiled, ["doc_id", "start"], 256)


_SPLICED = """WITH s AS (SELECT p_partkey AS p, p_partkey % 25 AS c, translate(sha256('n' || (p_partkey % 25)) || sha256('m' || (p_partkey % 25)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
x AS (SELECT p, substr(seq, p % 30 + 1, 10) || substr(seq, p % 30 + 21, 5 + p % 40) AS seq FROM s WHERE p % 7 > 0)
SELECT 't' || p AS name, 'g' || (p % 10) AS gene, CASE WHEN p % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS seq FROM x"""


@query(_SPLICED)
def q98_spliced(spark, d):
    """Transcripts of a gene table's lines; every seventh line states another number of exons and is left out."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chrom"), F.translate(F.concat(F.sha2(F.expr("concat('n', n_nationkey)"), 256), F.sha2(F.expr("concat('m', n_nationkey)"), 256)), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    e = F.expr
    fields = ["'0'", "concat('t', p)", "string(p % 25)", "if(p % 2 = 0, '+', '-')", "'0'", "'9'", "'0'", "'9'", "if(p % 7 > 0, '2', '3')", "concat(p % 30, ',', p % 30 + 20, ',')", "concat(p % 30 + 10, ',', p % 30 + 25 + p % 40, ',')", "'0'", "concat('g', p % 10)", "'a'", "'b'", "'c'"]
    lines = _t(spark, d, "part").select(F.col("p_partkey").alias("p")).select(F.concat_ws("\t", *[e(f) for f in fields]).alias("value"))
    return al.spliced(al.gene_exons(lines), al.tiles(n, 16), 16)


@query("""SELECT o_orderkey % 900 AS score, 'e' || (o_custkey % 9) AS target_id, 'q' || o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS query_number, o_custkey AS target_start, o_custkey + 7 AS target_end, '-' AS query_strand, CAST(90 AS BIGINT) AS query_size FROM orders""")
def q99_maf_hits(spark, d):
    e = F.expr
    block = F.concat(F.lit("# of a tool\n"), e("concat('a score=', o_orderkey % 900, ' EG2=1')"), e("concat('\\ns e', o_custkey % 9, ' ', o_custkey, ' 7 + 6000 ACGTACG')"), e("concat('\\ns q', o_orderkey, if(o_orderkey % 2 = 0, concat('|', o_custkey), ''), ' 3 7 - 90 ACGTACG\\n')"))
    return al.maf_hits(_t(spark, d, "orders").select(block.alias("value"))).select("score", "target_id", "query_id", "query_number", "target_start", "target_end", "query_strand", "query_size")


@query("SELECT 'k' || o_orderkey AS chunk, o_custkey % 3000 AS seconds FROM orders WHERE o_orderkey % 5 > 0")
def q100_chunk_times(spark, d):
    o, e = _t(spark, d, "orders"), F.expr
    at = "date_format(timestamp'2020-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, {}), 'yyyy-MM-dd HH:mm:ss')"
    begin = o.select(e(f"concat({at.format('0')}, ',123 INFO Processing chunk: k', o_orderkey, ' ...')").alias("value"))
    end = o.where("o_orderkey % 5 > 0").select(e(f"concat({at.format('o_custkey % 3000')}, ',999 INFO ', if(o_orderkey % 2 = 0, concat('Finished chunk: k', o_orderkey), concat('k', o_orderkey, ': Summarising it')))").alias("value"))
    return al.chunk_times(begin.unionByName(end))


@query("SELECT '#BEGIN' || chr(10) || 's_suppkey: ' || s_suppkey || chr(10) || 's_nationkey: ' || coalesce(CAST(nullif(s_nationkey, 3) AS VARCHAR), 'None') || chr(10) || '#END' || chr(10) AS value FROM supplier")
def q101_detail_lines(spark, d):
    return tx.detail_lines(_t(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey")))


@query("""WITH r AS (SELECT 'r' || l_orderkey AS q, CASE WHEN l_linenumber % 3 = 0 THEN '0' WHEN l_linenumber % 3 = 1 THEN '1' ELSE '2' END AS e, max(CASE WHEN l_partkey % 2 = 0 THEN 'SR' ELSE 'DR' END) AS k FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2)
SELECT '@' || q || '.' || k || '/' || e || chr(10) || repeat('A', 50) || chr(10) || '+' || chr(10) || repeat('I', 50) AS value FROM r""")
def q102_support_fastq(spark, d):
    e = F.expr
    letters = lambda c: e(f"repeat('{c}', if(l_quantity >= 10, 50, 49))")
    reads = _t(spark, d, "lineitem").select(e("concat('r', l_orderkey)").alias("qname"), e("case int(l_linenumber) % 3 when 0 then 1 when 1 then 65 else 129 end").alias("flag"), "l_partkey", letters("A").alias("seq"), letters("I").alias("qual"))
    return tx.support_fastq(reads, F.when(F.col("l_partkey") % 2 == 0, "SR").otherwise("DR"))


@query("""WITH m AS (SELECT user_id, event_id, 'c1' AS chrom, event_id AS a, event_id + 5 AS b, event_type FROM events), h AS (SELECT user_id, min(a) AS a, max(b) AS b, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS f, count(*) AS n FROM m GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS cluster, 0 AS part, '#BEGIN' || chr(10) || concat_ws(chr(9), 'c1', a - 500, b + 500, '+', f, n) AS value FROM h UNION ALL SELECT CAST(user_id AS VARCHAR), 1, 'read ' || event_id FROM m UNION ALL SELECT CAST(user_id AS VARCHAR), 2, '#END' FROM h""")
def q103_cluster_lines(spark, d):
    m = _t(spark, d, "events").select("user_id", "event_id", F.lit("c1").alias("chrom"), F.col("event_id").alias("start"), (F.col("event_id") + 5).alias("end"), F.lit("+").alias("strand"), F.col("event_type").alias("bam"))
    return tx.cluster_lines(m, ["user_id"], F.concat(F.lit("read "), F.col("event_id").cast("string")), ["start"], 500).select("cluster", "part", "value")


@query("SELECT DISTINCT printf('%08d-%d', c_custkey, c_nationkey) AS uuid FROM customer WHERE c_custkey % 3 > 0")
def q104_ids(spark, d):
    return al.ids(_t(spark, d, "customer").select(F.expr("concat(lpad(c_custkey, if(c_custkey % 3 > 0, 8, 9), '0'), '-', c_nationkey, '\tmore')").alias("value")))


@query("SELECT 'b' || s_suppkey AS bam, 'n' || s_nationkey AS name FROM supplier")
def q105_samples(spark, d):
    return al.samples(_t(spark, d, "supplier").select(F.expr("concat('n', s_nationkey, '  b', s_suppkey)").alias("value")), True)
