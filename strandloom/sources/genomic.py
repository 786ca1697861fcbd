"""Readers and writers of the text formats around aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PSL = "matches int, mismatches int, repmatches int, ncount int, qnuminsert int, qbaseinsert int, tnuminsert int, tbaseinsert int, strand string, qname string, qsize int, qstart int, qend int, tname string, tsize int, tstart int, tend int, blockcount int, blocksizes string, qstarts string, tstarts string"


def fasta_records(lines: Column) -> Column:
    """struct(seq_id, superfamily, subfamily, seq) of a record's text without its `>`; the id ends at the first blank."""
    head, body = F.substring_index(lines, "\n", 1), F.regexp_replace(F.regexp_replace(lines, r"^[^\n]*\n?", ""), r"\s", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    return F.struct(name.alias("seq_id"), F.substring_index(name, ":", 1).alias("superfamily"), F.when(F.contains(name, F.lit(":")), F.get(F.split(name, ":"), F.lit(1))).alias("subfamily"), body.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=">").where(F.trim("value") != "").select(fasta_records(F.col("value")).alias("r")).select("r.*")


def read_bed(spark: SparkSession, path: str, columns: str = "chrom string, start long, end long") -> DataFrame:
    return spark.read.schema(columns).csv(path, sep="\t", comment="#")


def read_contigs(spark: SparkSession, path: str, skip: DataFrame | None = None, least: int = 1_000_000) -> DataFrame:
    """(chrom, length) of an index of contigs, those longer than `least` and not in skip(chrom)."""
    rows = spark.read.schema("chrom string, length long").csv(path, sep="\t", comment="#").where(F.col("length") > least)
    return rows.join(skip, "chrom", "left_anti") if skip is not None else rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, all strings, NA for null."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA")


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with sorted blocks(start, end) on the target; a name's `chr` goes, and swapped ends are set right."""
    rows = spark.read.schema(PSL).csv(path, sep="\t")
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    blocks = F.array_sort(F.zip_with(ints("tstarts"), ints("blocksizes"), lambda s, n: F.struct(s.alias("start"), (s + n).alias("end"))))
    return rows.withColumns({"tname": F.regexp_replace("tname", "^chr", ""), "blocks": blocks, "tstart": F.least("tstart", "tend"), "tend": F.greatest("tstart", "tend")})


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """BED6 of a repeat annotation with two header lines: class, family and strand (C is -)."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where((F.size("f") >= 11) & F.col("f")[0].rlike("^[0-9]+$"))
    return parts.select(F.regexp_replace(F.col("f")[4], "^chr", "").alias("chrom"), F.col("f")[5].cast("long").alias("start"), F.col("f")[6].cast("long").alias("end"), F.col("f")[10].alias("class"), F.col("f")[9].alias("family"), F.when(F.col("f")[8] == "C", "-").otherwise(F.col("f")[8]).alias("strand"))


def write_calls(calls: DataFrame, path: str) -> None:
    calls.orderBy("Chromosome", "Left_Extreme").write.csv(path, sep="\t", header=True, nullValue="NA")


def vcf_lines(calls: DataFrame, samples: list[str]) -> DataFrame:
    """Lines of calls(chrom, pos, id, info, and a `gt:ds` string for each sample), sorted; the header is for the writer to add."""
    fixed = [F.col("chrom"), F.col("pos").cast("string"), F.col("id"), F.lit("."), F.lit("<INS>"), F.lit("."), F.lit("PASS"), F.col("info"), F.lit("GT:DS")]
    return calls.orderBy("chrom", "pos").select(F.concat_ws("\t", *fixed, *[F.coalesce(F.col(s), F.lit("./.:0.000")) for s in samples]).alias("value"))
