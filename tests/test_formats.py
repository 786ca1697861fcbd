"""Consensus, alignments and lines of other tools, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import consensus as cs
from strandloom.sources import alignments as al
from strandloom.sources import texts as tx
from strandloom.sources.genomic import vcf_lines


def best_score(a, b):
    """Affine local alignment, cell by cell."""
    low, n, m = -(10**9), len(b), len(a)
    h, e, f = ([[0] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)])
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(e[i - 1][j] - 2, h[i - 1][j] - 5)
            f[i][j] = max(f[i][j - 1] - 2, h[i][j - 1] - 5)
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -3), e[i][j], f[i][j])
    return max(map(max, h))


def cut_up(rng, text):
    out = list(text)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choices("ACGT", k=rng.randrange(3))
    return "".join(out) or "A"


def test_local_alignment_is_the_best():
    rng = random.Random(5)
    for _ in range(150):
        a = "".join(rng.choices("ACGT", k=rng.randrange(1, 50)))
        b = cut_up(rng, a[rng.randrange(len(a)) :]) if rng.random() < 0.7 else "".join(rng.choices("ACGT", k=20))
        hit, want = cs.local_alignment(a, b), best_score(a, b)
        assert (hit[0] if hit else 0) == want
        if hit:
            score, a0, a1, b0, b1, same, columns = hit
            assert 0 <= a0 < a1 <= len(a) and 0 <= b0 < b1 <= len(b) and same <= min(a1 - a0, b1 - b0) and columns >= max(a1 - a0, b1 - b0)
            assert best_score(a[a0:a1], b[b0:b1]) == score
    assert cs.local_alignment("", "A") is None and cs.local_alignment("AAAA", "CC") is None and cs.local_alignment("NN", "NN") is None


def test_ungapped_hit_is_the_best():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ("".join(rng.choices("ACGT", k=rng.randrange(1, 25))) for _ in range(2))
        want = max((sum(5 if x == y else -4 for x, y in zip(a[i : i + n], b[j : j + n])) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1)))
        hit = cs.ungapped_hit(a, b)
        assert (hit[0] if hit else 0) == max(want, 0)
        if hit:
            assert hit[2] - hit[1] == hit[4] - hit[3] and 5 * hit[5] - 4 * (hit[2] - hit[1] - hit[5]) == hit[0]


def test_consensus(spark):
    rng = random.Random(7)
    whole = "".join(rng.choices("ACGT", k=200))
    tiled = [whole[i : i + 60] for i in range(0, 141, 20)]
    cases = {
        "tiled": tiled, "one": tiled[:1], "same": tiled[:1] * 3, "short": ["A" * 20], "none": [], "null": [None, tiled[0]],
        "n": [tiled[0], "N" + tiled[1][1:]], "other": [tiled[0], "".join(rng.choices("ACGT", k=60))], "apart": ["A" * 30, "C" * 30, tiled[0]],
    }
    rows = [(k, i, s) for k, v in cases.items() for i, s in enumerate(v)]
    got = {r.k: (r.consensus, round(r.score, 6), r.n_reads) for r in cs.consensus(spark.createDataFrame(rows, "k string, i int, seq string"), ["k"], ["i"]).collect()}
    assert got["tiled"] == (whole, 1.0, 8) and got["one"] == (tiled[0], 1.0, 1) and got["same"] == (tiled[0], 1.0, 3) and got["null"] == (tiled[0], 1.0, 1)
    assert got["short"] == ("", 0.0, 0) and "none" not in got and got["other"][:2] == (tiled[0], 0.0) and got["apart"][:2] == ("A" * 30, 0.0)
    assert got["n"][0] == whole[:80] and got["n"][1] > 0.9
    again = {r.k: r for r in cs.consensus(spark.createDataFrame([("a", 0, "A" * 40), ("a", 1, tiled[0]), ("a", 2, tiled[1])], "k string, i int, seq string"), ["k"], ["i"], retry=True).collect()}
    assert again["a"].consensus == whole[:80]
    assert cs.grown(["A" * 40, tiled[0], tiled[1]], 0.9, False)[1] == 0.0


def test_trimmed(spark):
    rows = [("ACGTACGTAC", "IIIIII!!!!"), ("ACGTACGTAC", "IIIII!!!!I"), ("ACGT", "!!!!"), ("ACG", "III"), ("", "")]

    def plain(seq, qual):
        q = [ord(c) - 33 for c in qual]
        return next((seq[:i] for i in range(len(q) - 4) if sum(q[i : i + 4]) / 4 < 5), seq)

    got = [r.t for r in spark.createDataFrame(rows, "s string, q string").select(cs.trimmed(F.col("s"), F.col("q")).alias("t")).collect()]
    assert got == [plain(*r) for r in rows]


def test_library_hits_strands_and_ties(spark):
    rng = random.Random(8)
    one = "".join(rng.choices("ACGT", k=90))
    flip = one[::-1].translate(str.maketrans("ACGT", "TGCA"))
    hits = cs.library_hits(spark.createDataFrame([("a", one[10:50]), ("b", flip[10:50].lower()), ("c", "ACG"), ("d", None), ("e", "A" * 40)], "query_id string, seq string"), spark.createDataFrame([("t", one), ("u", None)], "target_id string, seq string"))
    assert {(r.query_id, r.strand, r.score, r.query_start, r.query_end, r.target_start, r.target_end, r.identity) for r in hits.collect()} == {("a", "+", 80, 0, 40, 10, 50, 1.0), ("b", "-", 80, 0, 40, 40, 80, 1.0)}


def test_sam_files(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:1\nq\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tRG:Z:x\tRG:Z:y\tCO:Z:a:b\nbad\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.sam\n\n")
    assert al.paths_of("a, b") == ["a", "b"]
    (row,) = al.read_sam(spark, al.paths_of(f"{tmp_path}/list.txt", spark)).collect()
    assert row.bam.endswith("a.sam") and row.chrom is None and row.pos == -1 and row.rg == "x" and row.tags == {"RG": "x", "CO": "a:b"} and row.seq == "AC"


def test_maf_files(spark, tmp_path):
    (tmp_path / "x.maf").write_text("# LAST\n#\na score=30 E=1\ns T 2 3 + 9 ACG\ns u|4 0 3 + 3 ACG\n\na score=5\ns T 0 1 + 9 A\ns v 0 1 - 3 A\n\n# end\n")
    got = sorted((r.score, r.query_id, r.query_number, r.target_start, r.target_end, r.query_strand) for r in al.read_maf(spark, str(tmp_path / "x.maf")).collect())
    assert got == [(5, "v", 0, 0, 1, "-"), (30, "u", 4, 2, 5, "+")]


def test_fetch_across_tiles(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("ACGT", k=50))
    spans = [(i, "c", a, b) for i, (a, b) in enumerate([(0, 50), (-3, 5), (45, 60), (7, 8), (8, 16), (9, 9), (60, 70), (3, 33)])]
    got = {r.i: r.seq for r in al.fetch(spark.createDataFrame(spans, "i int, chrom string, start long, end long"), al.tiles(spark.createDataFrame([("c", text), ("d", "")], "chrom string, seq string"), 8), ["i"], 8).collect()}
    assert got == {i: text[max(a, 0) : b] for i, _, a, b in spans if text[max(a, 0) : b]}


def test_lines_and_folders(spark, tmp_path):
    members = spark.createDataFrame([("k", "1", 10, 20, "+", "b"), ("k", "1", 5, 9, "+", "a")], "k string, chrom string, start int, end int, strand string, bam string")
    blocks = tx.cluster_lines(members, ["k"], F.col("bam"), ["start"], 2).orderBy("cluster", "part", "order")
    assert [r.value for r in blocks.collect()] == ["#BEGIN\n1\t3\t22\t+\ta,b\t2", "a", "b", "#END"]
    tx.write_by_key(members, str(tmp_path / "m"), "chrom", "start")
    assert (tmp_path / "m" / "chrom=1").is_dir() and spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert [r.value for r in tx.fasta_lines(spark.createDataFrame([("a", "AC"), ("b", None), ("c", "")], "n string, s string"), "n", "s").collect()] == [">a\nAC"]
    head = tx.vcf_header(["s1"])
    assert head[0] == "##fileformat=VCFv4.1" and head[-1].endswith("FORMAT\ts1")
    line = vcf_lines(spark.createDataFrame([("1", 5, "i", "END=6", None)], "chrom string, pos int, id string, info string, s1 string"), ["s1"]).first().value
    assert len(line.split("\t")) == len(head[-1].split("\t")) and line.endswith("./.:0.000")


@pytest.mark.parametrize("schema", ["value string"])
def test_empty_tables(spark, schema):
    nothing = spark.createDataFrame([], schema)
    for parse in (al.sam_reads, al.maf_hits, al.gene_exons, al.ids, al.samples, al.chunk_times):
        assert parse(nothing).count() == 0
    assert cs.consensus(spark.createDataFrame([], "k string, i int, seq string"), ["k"], ["i"]).count() == 0


def test_ungapped_hits_of_many_pairs_are_those_of_each():
    """pairs of equal lengths go through together; the first diagonal and the first end win ties."""

    def plain(a, b):
        best = None
        for shift in range(1 - len(a), len(b)):
            sums = [0]
            for j, x in enumerate(a):
                sums.append(sums[-1] + (5 if 0 <= j + shift < len(b) and x != "N" and x == b[j + shift] else -4))
            low = [min(sums[: e + 1]) for e in range(len(sums))]
            gain = max(s - l for s, l in zip(sums, low))
            if gain > 0 and (best is None or gain > best[0]):
                end = next(e for e in range(len(sums)) if sums[e] - low[e] == gain)
                start = sums.index(low[end])
                best = (gain, start, end, start + shift, end + shift, (gain + 4 * (end - start)) // 9)
        return best

    rng = random.Random(11)
    pairs = [("".join(rng.choices("ACN", k=rng.choice((0, 7, 12)))), "".join(rng.choices("ACGN", k=rng.choice((0, 5, 12))))) for _ in range(400)]
    assert cs.ungapped_hits(*map(list, zip(*pairs))) == [plain(a, b) if a and b else None for a, b in pairs]
    assert cs.ungapped_hits([None, "AC"], ["AC", None]) == [None, None]


def test_local_alignments_of_many_pairs_are_those_of_each(spark, monkeypatch):
    """pairs of different lengths fill their tables together, and clusters that are cut between two turns go on."""
    rng = random.Random(12)
    a, b = (["".join(rng.choices("ACG", k=rng.randrange(0, 30))) for _ in range(300)] for _ in range(2))
    together = cs.local_alignments(a, b)
    assert together == [cs.local_alignment(x, y) for x, y in zip(a, b)]
    assert [(h[0] if h else 0) == best_score(x, y) for x, y, h in zip(a, b, together)] == [True] * 300
    monkeypatch.setattr(cs, "CELLS", 500)
    assert cs.local_alignments(a, b) == together
    whole = ["".join(rng.choices("ACGT", k=200)) for _ in range(7)]
    rows = [(k, i, whole[k][10 * i : 10 * i + 60]) for k in range(7) for i in range(k + 1)]
    want = {k: cs.grown([s for c, _, s in rows if c == k], 0.9, False) for k in range(7)}
    for size in (1, 3, 1000):
        calls = []
        monkeypatch.setattr(cs, "TOGETHER", size)
        monkeypatch.setattr(cs, "sorted_fold", lambda reads, keys, order, schema, fold: calls.append(fold))
        cs.consensus(spark.createDataFrame(rows, "k int, i int, seq string"), ["k"], ["i"])
        assert {k: tuple(r) for k, *r in calls[0](iter([(k, i, s) for k, i, s in rows]))} == want


def test_trimming_reads_qualities_once(spark):
    """a read's qualities are no longer split again for each of its windows."""
    frame = spark.createDataFrame([("ACGTACGTAC", "IIII!!!!II"), ("ACG", "III")], "seq string, qual string")
    out = frame.repartition(2).select(cs.trimmed(F.col("seq"), F.col("qual")).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(r.t for r in out.collect()) == ["ACG", "ACGT"]
