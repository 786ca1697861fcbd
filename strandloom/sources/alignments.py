"""Lines of other tools as rows: alignments, genes, lists and logs; and sequence by position.

Each parser takes a frame with a column `value`, as spark.read.text gives it, so it works on files, streams and columns.
Lines that aren't of the format are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators.names import free

TILE = 1 << 16
GENE = "bin name chrom strand tx_start tx_end cds_start cds_end exon_count exon_starts exon_ends score gene cds_start_stat cds_end_stat exon_frames"


def paths_of(spec: str, spark: SparkSession | None = None) -> list[str]:
    """Paths of a comma-separated list, or of a .txt file with one on each line."""
    if spec.endswith(".txt"):
        return [r.value.strip() for r in spark.read.text(spec).collect() if r.value.strip()]  # a list of samples, one line each
    return [p.strip() for p in spec.split(",") if p.strip()]


def sam_reads(lines: DataFrame) -> DataFrame:
    """Reads (bam is null) of SAM lines: 0-based positions, `*` is null, `=` is the read's own chromosome, tags are a map of
    text, of a repeated tag the first. Unplaced reads stay."""
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("@")) & (F.size(f) >= 11)).select(f.alias("f"))
    at = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit("*"))
    name = lambda x: F.substring_index(x, ":", 1)
    extra = F.when(F.size("f") > 11, F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    first = F.filter(extra, lambda x, i: F.array_position(F.transform(extra, name), name(x)) == i + 1)
    tags = F.map_from_entries(F.transform(first, lambda x: F.struct(name(x), F.regexp_extract(x, r"^[^:]*:[^:]*:(.*)$", 1))))
    number = lambda i: F.get("f", F.lit(i)).try_cast("long")
    parsed = rows.select(at(0).alias("qname"), number(1).cast("int").alias("flag"), at(2).alias("chrom"), (number(3) - 1).alias("pos"), number(4).cast("int").alias("mapq"), at(5).alias("cigar"), F.when(F.get("f", F.lit(6)) == "=", at(2)).otherwise(at(6)).alias("mate_chrom"), (number(7) - 1).alias("mate_pos"), at(9).alias("seq"), at(10).alias("qual"), tags.alias("tags"))
    return parsed.select(F.lit(None).cast("string").alias("bam"), F.try_element_at("tags", F.lit("RG")).alias("rg"), "qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "seq", "qual", F.try_element_at("tags", F.lit("NM")).try_cast("int").alias("nm"), "tags")


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of SAM files, with the file as bam."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return _with_path(lines, sam_reads)


def _with_path(lines: DataFrame, parse) -> DataFrame:
    # The path rides as a tag of its own, so that the parser needs to know nothing of it.
    tagged = lines.withColumn("value", F.when(F.startswith("value", F.lit("@")), F.col("value")).otherwise(F.concat("value", F.lit("\tZZ:Z:"), "path")))
    return parse(tagged).withColumn("bam", F.try_element_at("tags", F.lit("ZZ"))).withColumn("tags", F.map_filter("tags", lambda k, v: k != "ZZ"))


def in_region(reads: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Reads of with_alignment that overlap the half-open region; all of a chromosome, or all reads, if it isn't bounded."""
    kept = reads if chrom is None else reads.where(F.col("chrom") == chrom)
    kept = kept if end is None else kept.where(F.col("pos") < end)
    return kept if start is None else kept.where(F.col("ref_end") > start)


def maf_hits(blocks: DataFrame) -> DataFrame:
    """Alignments of blocks of three lines (blank lines split blocks, `#` lines don't count): target and query with start, end,
    strand, size and aligned text. A query `id|n` is the n-th distal read of id; others have 0."""
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    parts = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    rows = blocks.select(parts.alias("p")).where((F.size("p") == 3) & (F.size(F.get("p", F.lit(1))) == 7) & (F.size(F.get("p", F.lit(2))) == 7)).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("t"), F.get("p", F.lit(2)).alias("q"))

    def side(name: str, c: str) -> list[Column]:
        start, n = F.get(c, F.lit(2)).try_cast("long"), F.get(c, F.lit(3)).try_cast("long")
        return [start.alias(f"{name}_start"), (start + n).alias(f"{name}_end"), F.get(c, F.lit(4)).alias(f"{name}_strand"), F.get(c, F.lit(5)).try_cast("long").alias(f"{name}_size"), F.get(c, F.lit(6)).alias(f"{name}_text")]

    query = F.get("q", F.lit(1))
    score = F.regexp_extract(F.try_element_at("a", F.lit(2)), "^score=(-?[0-9]+)", 1).try_cast("long")
    return rows.select(score.alias("score"), F.get("t", F.lit(1)).alias("target_id"), F.substring_index(query, "|", 1).alias("query_id"), F.when(F.contains(query, F.lit("|")), F.substring_index(query, "|", -1).try_cast("long")).otherwise(F.lit(0).cast("long")).alias("query_number"), *side("target", "t"), *side("query", "q"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    return maf_hits(spark.read.text(path, lineSep="\n\n"))


def gene_exons(lines: DataFrame) -> DataFrame:
    """Transcripts of a gene table with exons(start, end); those whose lists are not of the stated length are left out."""
    names = GENE.split()
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(f) == len(names)) & ~F.startswith("value", F.lit("#"))).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    counted = rows.withColumns({"starts": ints("exon_starts"), "ends": ints("exon_ends")}).where((F.size("starts") == F.size("ends")) & (F.size("starts") == F.col("exon_count").try_cast("int")))
    exons = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return counted.select("name", "gene", "chrom", "strand", F.col("tx_start").try_cast("long").alias("tx_start"), F.col("tx_end").try_cast("long").alias("tx_end"), exons.alias("exons"))


def pieces_of(seq: Column, size: int) -> Column:
    """The pieces of `size` letters of a text, in their order, cut in one pass: a substring for each would go through the text from its begin each time."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def tiles(contigs: DataFrame, size: int = TILE) -> DataFrame:
    """(chrom, tile, seq) of contigs(chrom, seq), in pieces of `size` bases."""
    cut = contigs.where(F.length("seq") > 0).select("chrom", F.posexplode(pieces_of(F.col("seq"), size)).alias("tile", "seq"))
    return cut.select("chrom", F.col("tile").cast("long").alias("tile"), "seq")


def fetch(spans: DataFrame, tiled: DataFrame, key: list[str], size: int = TILE, out: str = "seq") -> DataFrame:
    """(key, out): the half-open span [start, end) of each chrom of spans(key, chrom, start, end); key is unique. What lies beyond
    a contig is left out, and so are spans of which nothing is left. A span meets only its own tiles."""
    low_, high_, tile_, bases, parts = free(spans, "low", "high", "tile", "bases", "parts")
    low = F.greatest(F.col("start"), F.lit(0))
    asked = spans.where(low < F.col("end")).select(*key, F.col("chrom").alias("chrom"), low.alias(low_), F.col("end").alias(high_), F.explode(F.sequence(F.floor(low / size), F.floor((F.col("end") - 1) / size))).alias(tile_))
    begin, stop = F.greatest(F.col(low_) - F.col(tile_) * size, F.lit(0)), F.least(F.col(high_) - F.col(tile_) * size, F.lit(size))
    known = tiled.select(F.col("chrom").alias("chrom"), F.col("tile").alias(tile_), F.col("seq").alias(bases))
    # No broadcast: what is known of the size of derived sequences is far too little.
    met = asked.join(known.hint("merge"), ["chrom", tile_]).withColumn(bases, F.substring(bases, (begin + 1).cast("int"), (stop - begin).cast("int")))
    joined = met.where(F.length(bases) > 0).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(tile_).alias("tile"), F.col(bases).alias("bases")))).alias(parts))
    return joined.select(*key, F.array_join(F.transform(parts, lambda p: p["bases"]), "").alias(out))


def spliced(genes: DataFrame, tiled: DataFrame, size: int = TILE) -> DataFrame:
    """(name, gene, seq) of transcripts with unique names: exons put together, on the gene's strand."""
    each = genes.select("name", "gene", "strand", "chrom", F.posexplode("exons").alias("n", "x")).select("name", "gene", "strand", "chrom", "n", F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    parts = fetch(each, tiled, ["name", "gene", "strand", "n"], size, "bases")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "bases"))), lambda p: p["bases"]), "")
    return parts.groupBy("name", "gene", "strand").agg(seq.alias("seq")).select("name", "gene", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def ids(lines: DataFrame) -> DataFrame:
    """(uuid): first words whose first hyphen is the ninth character."""
    return lines.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("uuid")).where(F.col("uuid").rlike("^[^-]{8}-")).distinct()


def samples(lines: DataFrame, name_first: bool = False) -> DataFrame:
    """(bam, name) of two words a line, in either order."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(f) >= 2)
    return rows.select(F.get(f, F.lit(1 if name_first else 0)).alias("bam"), F.get(f, F.lit(0 if name_first else 1)).alias("name"))


def chunk_times(lines: DataFrame) -> DataFrame:
    """(chunk, seconds) of a log: from the last start of a chunk to its last end; those without either are left out."""
    f = F.split(F.trim("value"), r"\s+")
    v = F.col("value")
    begins, sums, ends = F.contains(v, F.lit("Processing chunk:")), v.rlike("Summarising|Mapping 0 breakends"), F.contains(v, F.lit("Finished chunk:"))
    chunk = F.when(begins, F.try_element_at(f, F.lit(-2))).when(ends, F.try_element_at(f, F.lit(-1))).when(sums, F.rtrim(F.try_element_at(f, F.lit(4)), F.lit(":")))
    at = F.unix_seconds(F.try_to_timestamp(F.substring_index(F.concat_ws(" ", F.get(f, F.lit(0)), F.try_element_at(f, F.lit(2))), ",", 1), F.lit("yyyy-MM-dd HH:mm:ss")))
    rows = lines.where((begins | sums | ends) & (F.size(f) >= 4)).select(chunk.alias("chunk"), at.alias("at"), begins.alias("begins"))
    met = rows.groupBy("chunk").agg(F.max(F.when(F.col("begins"), F.col("at"))).alias("a"), F.max(F.when(~F.col("begins"), F.col("at"))).alias("b"))
    return met.where("a is not null and b is not null").select("chunk", (F.col("b") - F.col("a")).alias("seconds"))
