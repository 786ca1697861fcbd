"""Rows as text of the formats that other tools read, one column `value`, for write.text; and tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import has_flag
from ..operators.reads import READ1, READ2

# The lines that begin a file of calls.
VCF_HEADER = (
    "##fileformat=VCFv4.1",
    "##phasing=none",
    '##ALT=<ID=INS,Description="Insertion">',
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dose of the insertion">',
)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def detail_lines(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`#BEGIN`, a `column: value` line each, `#END` and a blank line; null is None."""
    named = [F.concat(F.lit(f"{c}: "), _text(F.col(c))) for c in columns or rows.columns]
    return rows.select(F.concat_ws("\n", F.lit("#BEGIN"), *named, F.lit("#END"), F.lit("")).alias("value"))


def cluster_lines(members: DataFrame, key: list[str], line: Column, order: list[str], pad: int = 0) -> DataFrame:
    """A block for each cluster: chromosome, padded start and end, strand, files and size, then its members' lines. Blocks are
    put together from lines that carry their cluster's order, so no cluster is one row: write sorted by `cluster`, `part` and `order`."""
    heads = members.groupBy(*key).agg(F.min("chrom").alias("c"), F.min("start").alias("a"), F.max("end").alias("b"), F.min("strand").alias("s"), F.array_join(F.array_sort(F.collect_set("bam")), ",").alias("f"), F.count(F.lit(1)).alias("n"))
    cluster = F.concat_ws("\x01", *[F.col(k).cast("string") for k in key]).alias("cluster")
    rank = F.concat_ws("\x01", *[F.call_function("lpad", F.col(c).cast("string"), F.lit(20), F.lit(" ")) for c in order])
    head = heads.select(cluster, F.lit(0).alias("part"), F.lit("").alias("order"), F.concat(F.lit("#BEGIN\n"), F.concat_ws("\t", "c", (F.col("a") - pad).cast("string"), (F.col("b") + pad).cast("string"), "s", "f", F.col("n").cast("string"))).alias("value"))
    body = members.select(cluster, F.lit(1).alias("part"), rank.alias("order"), line.alias("value"))
    return head.unionByName(body).unionByName(heads.select(cluster, F.lit(2).alias("part"), F.lit("").alias("order"), F.lit("#END").alias("value")))


def support_fastq(reads: DataFrame, kind: Column, least: int = 50) -> DataFrame:
    """Four lines for each read of `least` bases: its name with kind (SR or DR) and end (1, 2, or 0 for single ones). A read
    of both kinds is written once, as SR."""
    end = F.when(has_flag(F.col("flag"), READ1), "1").when(has_flag(F.col("flag"), READ2), "2").otherwise("0")
    rows = reads.where((F.length("seq") >= least) & F.col("qual").isNotNull()).select("qname", end.alias("e"), F.struct(kind.alias("kind"), "seq", "qual").alias("r"))
    once = rows.groupBy("qname", "e").agg(F.max("r").alias("r"))
    return once.select(F.concat("qname", F.lit("."), "r.kind", F.lit("/"), "e").alias("name"), "r.*").select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def fasta_lines(rows: DataFrame, name: str, seq: str) -> DataFrame:
    """`>name` and the sequence; rows without one are left out."""
    return rows.where(F.length(seq) > 0).select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), seq).alias("value"))


def vcf_header(samples: list[str]) -> list[str]:
    return [*VCF_HEADER, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_by_key(rows: DataFrame, path: str, key: str, order: str) -> None:
    """Parquet with a folder for each key. Rows are dealt by range of the key and then of `order`, so a heavy key is many files."""
    rows.repartitionByRange(key, order).sortWithinPartitions(key, order).write.partitionBy(key).parquet(path)
