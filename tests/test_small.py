"""Small operators and formats that no query runs, and names that clash."""

import glob

from pyspark.sql import functions as F

from strandloom.operators import intervals, reads, resolve
from strandloom.sources import genomic


def test_tables_are_read_and_calls_written(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Chromosome\tLeft_Extreme\tx\nb\t2\tNA\na\t10\tq\na\t3\t\n")
    table = genomic.read_table(spark, str(tmp_path / "t.txt"))
    assert table.columns == ["Chromosome", "Left_Extreme", "x"] and [r.x for r in table.where("Left_Extreme = '2'").collect()] == [None]
    genomic.write_calls(table.withColumn("Left_Extreme", F.col("Left_Extreme").cast("int")), str(tmp_path / "out"))
    lines = [line for f in sorted(glob.glob(str(tmp_path / "out" / "part-*"))) for line in open(f).read().splitlines()]
    body = [line.split("\t") for line in lines if not line.startswith("Chromosome")]
    assert [r[:2] for r in body] == [["a", "3"], ["a", "10"], ["b", "2"]] and body[2][2] == "NA"
    assert len({line for line in lines if line.startswith("Chromosome")}) == 1


def test_clipped_parts_and_members(spark):
    rows = [("f", "q1", "5S10M", "AAAAACCCCCGGGGG", 0), ("f", "q1", "10M5S", "CCCCCGGGGGTTTTT", 0), ("f", "q2", "3S9M3S", "AAACCCCCCCCCTTT", 0), ("g", "q1", "4M", "ACGT", 0), ("f", "q3", None, "ACGT", None)]
    frame = reads.with_alignment(spark.createDataFrame(rows, "bam string, qname string, cigar string, seq string, pos long"))
    got = [r.c for r in frame.orderBy("bam", "qname", "cigar").select(reads.clipped_part(F.col("seq")).alias("c")).collect()]
    assert got[:3] == ["TTTTT", "AAAAA", "AAA"]
    names = spark.createDataFrame([("f", "q1"), ("f", "q1"), (None, "q2")], "bam string, qname string")
    assert sorted(r.cigar for r in reads.members_of(frame, names).collect()) == ["10M5S", "5S10M"]
    assert reads.members_of(frame, names.limit(0)).count() == 0


def test_families_of_a_library(spark):
    calls = spark.createDataFrame([(1, "old", "s1"), (2, "old", "s9"), (3, None, None)], "id int, Superfamily string, Subfamily string")
    library = spark.createDataFrame([("A", "s1"), ("B", "s1"), ("C", None)], "superfamily string, subfamily string")
    assert sorted(tuple(r) for r in resolve.repaired_ids(calls, library).collect()) == [(1, "B", "s1"), (2, "old", "s9"), (3, None, None)]


def test_intervals_with_clashing_names(spark):
    a = spark.createDataFrame([(1, "c", 0, 10, "mine", 5, 9, 7, 1.5), (2, "c", 50, 60, "mine", 5, 9, 7, 1.5)], "id int, chrom string, start long, end long, annotation string, x int, n int, label int, mean_score double").withColumn("score", F.lit(3))
    b = spark.createDataFrame([("c", 2, 6, 2.0, "q"), ("c", 4, 20, 4.0, "p"), ("c", 5, 9, None, None)], "b_chrom string, b_start long, b_end long, score double, label string").withColumn("x", F.lit(1))
    assert {r.id: r.annotation for r in intervals.annotate(a, b, ["id"], 8).collect()} == {1: "p;q", 2: "NA"}
    means = {r.id: r.mean_score for r in intervals.weighted_mean(a, b.where("score is not null"), ["id"], 8).collect()}
    assert means[2] == 0.0 and 2.0 < means[1] < 4.0
    assert intervals.annotate(a.limit(0), b, ["id"], 8).collect() == [] and intervals.weighted_mean(a, b.limit(0), ["id"], 8).where("mean_score <> 0").count() == 0
