"""Operators on reads, calls and alignments against plain Python, boundaries included."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.jobs.registry import QUERIES
from strandloom.operators import breakends as be
from strandloom.operators import evidence as ev
from strandloom.operators import outliers
from strandloom.operators import reads as rd

DATA = "/root/testdata/sf0.001"
READ = "bam string, rg string, qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, seq string, qual string, nm int, tags map<string,string>"


def read(**k):
    base = dict(bam="/x/a.bam", rg=None, qname="q", flag=1, chrom="1", pos=100, mapq=20, cigar="10S40M", mate_chrom="1", mate_pos=200, seq="A" * 50, qual="I" * 50, nm=1, tags={"NM": "1", "XX": "2"})
    return tuple((base | k).values())


def test_alignment_and_split(spark):
    cigars = ["10S40M", "40M10S", "5H10S30M2D5M5S3H", "10M", "3S5M3I7M2N4M", None, "2S5M2S"]
    rows = rd.split_reads(rd.with_alignment(spark.createDataFrame([read(qname=str(i), cigar=c) for i, c in enumerate(cigars)], READ))).orderBy("qname").collect()
    assert [(r.qstart, r.qend, r.rlen, r.alen) for r in rows] == [(10, 50, 50, 40), (0, 40, 50, 40), (10, 45, 50, 37), (0, 10, 10, 10), (3, 22, 22, 18), (0, 0, 0, 0), (2, 7, 9, 5)]
    assert [(r.side, r.breakpos) for r in rows][:2] == [("left", 100), ("right", 139)] and (rows[6].side, rows[6].breakpos) == ("left", 100)


def test_clipped_boundaries(spark):
    kept = dict(clip3=dict(cigar="3S47M"), minor2=dict(cigar="2S38M10S"), n4=dict(seq="NNNN" + "A" * 46), equal=dict())
    gone = dict(clip2=dict(cigar="2S48M"), minor3=dict(cigar="3S37M10S"), n5=dict(seq="NNNNN" + "A" * 45), dup=dict(flag=1025), unmapped=dict(flag=5), last=dict(qual="I" * 49 + "!"))
    frame = spark.createDataFrame([read(qname=k, **v) for k, v in (kept | gone).items()], READ)
    assert {r.qname for r in rd.clipped(rd.with_alignment(frame)).collect()} == set(kept)


def test_last_base_statistic(spark):
    rng = random.Random(3)
    quals = ["".join(rng.choice("!5ISZ\n") for _ in range(rng.randrange(2, 60))) for _ in range(40)] + ["I", "", "IIII", "IIIA"]

    def z(q):
        if len(set(q)) < 2:
            return 0.0
        n, m, last = len(q), len(q) - 1, q[-1]
        u = sum(x < last for x in q[:-1]) + sum(x == last for x in q[:-1]) / 2
        t = 1 - sum(q.count(x) ** 3 - q.count(x) for x in set(q)) / (n**3 - n)
        return abs((max(u, m - u) - m / 2 - 0.5) / (t * m * (n + 1) / 12) ** 0.5)

    got = spark.createDataFrame(list(enumerate(quals)), "i int, q string").select("i", rd.last_base_z(F.col("q")).alias("z")).collect()
    assert all(abs(r.z - z(quals[r.i])) < 1e-9 for r in got)


def test_discordant_boundaries(spark):
    at = lambda d: dict(mate_pos=100 + d)
    rows = {"9999": at(9999), "10000": at(10000), "10001": at(10001), "other": dict(mate_chrom="2"), "mate": dict(flag=9), "dup": dict(flag=1025) | at(99999), "second": dict(flag=257) | at(99999), "mapq0": dict(mapq=0) | at(99999)}
    frame = rd.with_alignment(spark.createDataFrame([read(qname=k, **v) for k, v in rows.items()], READ))
    assert {r.qname for r in rd.discordant_near_site(frame).collect()} == {"10001", "other", "mate"}
    far = {r.qname: r.apart for r in rd.discordant(frame).collect()}
    assert far == {"10000": 10000, "10001": 10001, "other": 3_000_000_000, "second": 99999}


def test_reduced_keeps_tags_of_the_list(spark):
    frame = spark.createDataFrame([read(), read(qname="short", cigar="9S41M"), read(qname="hard", cigar="10S35M5H"), read(qname="none", cigar=None, flag=5)], READ)
    rows = {r.qname: r.tags for r in rd.reduced(frame).collect()}
    assert rows == {"q": {"NM": "1"}, "none": {"NM": "1"}}


def test_mates_of_one_pair(spark):
    one, two = read(flag=65, pos=100, mate_pos=300, seq="AC"), read(flag=129, pos=300, mate_pos=100, seq="GT")
    lost, extra = read(flag=133, pos=900, seq="TT"), read(flag=129 + 2048, pos=300, mate_pos=100, seq="CC")
    frame = spark.createDataFrame([one, two, lost, extra], READ)
    assert [r.mate_seq for r in rd.mates(frame, frame.where("seq = 'AC'")).collect()] == ["GT"]
    assert [r.mate_seq for r in rd.mates(frame, frame.where("seq = 'AC'"), unmapped=True).collect()] == ["TT"]


def test_clusters_use_a_single_reads_own_middle(spark):
    """A read's own middle stands for it while it is alone: 80 to 190 is within 100 of 125, not of 80."""
    split = spark.createDataFrame([("1", 80, 125), ("1", 190, 190), ("1", 500, 400), ("1", 501, 501)], "chrom string, breakpos long, middle long")
    assert sorted((r.first, r.last, r.n) for r in be.sr_clusters(split).collect()) == [(80, 190, 2), (500, 500, 1), (501, 501, 1)]


def test_one_chromosome_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [("1", p, p) for p in (rng.randrange(0, 5_000_000) for _ in range(3000))]
    pos, want, now = sorted(p for _, p, _ in rows), [], []
    for p in pos:
        if now and abs(now[len(now) // 2] - p) > 1000:
            want.append((now[0], now[-1], len(now)))
            now = []
        now.append(p)
    want.append((now[0], now[-1], len(now)))
    got = be.sr_clusters(spark.createDataFrame(rows, "chrom string, breakpos long, middle long").repartition(9), 1000).collect()
    assert sorted((r.first, r.last, r.n) for r in got) == want


def test_genotype_boundaries(spark):
    """Breaks one base off count, two off don't; a read that only touches a position doesn't span it."""
    reads = rd.with_alignment(spark.createDataFrame([read(qname="alt", pos=501), read(qname="off", pos=502), read(qname="span", pos=480, cigar="50M"), read(qname="touch", pos=500, cigar="50M"), read(qname="right", pos=460, cigar="40M10S"), read(qname="short", pos=500, cigar="5S45M"), read(qname="low", pos=500, mapq=9)], READ))
    sites = spark.createDataFrame([(1, "1", 500, 500)], "site int, site_chrom string, low long, high long")
    assert [(r.alt, r.ref) for r in be.break_counts(reads, sites).collect()] == [(2, 1)]


def test_matched_breakends_are_greedy_and_whole(spark):
    rows = [tuple(r) for r in QUERIES["Q56_matched_breakends"](spark, DATA).select("l", "r", "score").collect()]
    ends = {(r.chrom, r.side, r.breakpos) for r in QUERIES["Q54_breakends"](spark, DATA).collect()}
    pairs = sorted(((r.chrom, r.left_pos, r.right_pos, r.score) for r in QUERIES["Q55_breakend_pairs"](spark, DATA).collect()), key=lambda r: (-r[3], f"{r[0]}:left:{r[1]}", f"{r[0]}:right:{r[2]}"))
    used, want = set(), set()
    for c, a, b, _ in pairs:
        if (c, "left", a) not in used and (c, "right", b) not in used:
            used |= {(c, "left", a), (c, "right", b)}
            want.add((f"{c}:left:{a}", f"{c}:right:{b}"))
    assert {(l, r) for l, r, _ in rows if l and r} == want
    assert sorted(x for l, r, _ in rows for x in (l, r) if x) == sorted(f"{c}:{s}:{p}" for c, s, p in ends)


def test_hash_sample_is_stable_and_bounded(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = [sorted(map(tuple, ev.hash_sample(frame.repartition(n), ["k"], ["id"], 20).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_isolation_finds_planted_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [("f", float(a), float(b), False) for a, b in rng.normal(0, 1, (500, 2))] + [("f", 12.0 + i, -11.0, True) for i in range(5)] + [(None, 1.0, 1.0, False)]
    got = outliers.isolation(spark.createDataFrame(rows, "family string, a double, b double, planted boolean"), "family", ["a", "b"]).collect()
    usual = statistics.median(r.outlier_score for r in got if not r.planted)
    assert len(got) == len(rows) and all(r.outlier for r in got if r.planted) and usual < 0.5
    # A tree's path is the number of its cuts on a row's way, and what its leaf still holds.
    tree = outliers.grow(np.arange(8.0)[:, None], np.random.default_rng(1), 3)

    def walk(k, x):
        return tree[k, 4] if tree[k, 0] < 0 else 1 + walk(int(tree[k, 2 if x < tree[k, 1] else 3]), x)

    assert list(outliers.path(tree, np.arange(8.0)[:, None])) == [walk(0, x) for x in range(8)]


def test_isolation_goes_down_all_trees_together():
    """Whole trees give each row, of any number, the mean of the paths that the trees themselves give."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (700, 3)), 1)
    trees = [outliers.grow(x[rng.choice(700, 60)], rng, 6) for _ in range(9)]
    want = np.mean([outliers.path(t, x) for t in trees], axis=0)
    assert (outliers.mean_path([outliers.laid(t, 6) for t in trees], x, 64) == want).all()


def test_sequence_functions(spark):
    cases = [
        (sq.widest_gap(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (9, 12), (16, 20))])), (5, 9)),
        (sq.longest_try(F.array(F.lit("AC"), F.lit("ACG"), F.lit("TTT"))), "ACG"),
        (sq.target_site(F.lit("ACGT"), F.lit("ACTT"), F.lit("GGA"), F.lit("TGA")), 4),
        (sq.cigar_match(F.lit("5S10M2I10M"), F.lit(2)), 0.9), (sq.cigar_match(F.lit("5S"), F.lit(2)), -1.0),
        (sq.with_tail(F.lit("C"), 3), "CAAA"), (sq.only_poly_a(F.lit("A" * 96 + "CCCC")), True), (sq.only_poly_a(F.lit("A" * 95 + "CCCCC")), False), (sq.only_poly_a(F.lit("")), False),
        (sq.uncovered(F.lit(10), F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))), [(0, 2), (9, 10)]),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for got, (_, want) in zip(row, cases):
        assert (list(map(tuple, got)) if isinstance(got, list) else tuple(got) if isinstance(got, tuple) else got) == want


def test_psl_scores(spark):
    row = spark.createDataFrame([(90, 5, 4, 1, 2, 10, 110, 1000, 1150)], "matches int, mismatches int, repmatches int, qnuminsert int, tnuminsert int, qstart int, qend int, tstart int, tend int")
    r = row.select(*[v.alias(k) for k, v in sq.psl_scores().items()]).first()
    assert (r.score, r.span) == (90 + 2 - 5 - 1 - 2, 150) and abs(r.pctmatch - (100 - 1000 * (5 + 1 + 0) / 99 * 0.1)) < 1e-9


def test_sites_look_counts_up_and_meet_no_reads(spark, monkeypatch):
    """Short, odd and deep reads against plain loops; without odd ones no join of reads and sites is made."""
    import random

    from strandloom.operators import breakends as be
    from strandloom.operators import reads as rd

    rng = random.Random(5)
    shapes = ["60M", "7S60M", "60M9S", "8S12M7S", "12M", "7S50M7D", "6S40M12S", "20M9S"]
    rows = [("b" + str(rng.randrange(2)), 0, "c", rng.randrange(90), 60, rng.choice(shapes)) for _ in range(400)]
    sites = [(i, "c", s, s + w) for i in range(40) for s, w in [(rng.randrange(120), rng.choice([0, 0, 3, 7, 50]))]]
    frame = lambda r: rd.with_alignment(spark.createDataFrame(r, "bam string, flag int, chrom string, pos long, mapq int, cigar string"))
    places = lambda s: spark.createDataFrame(s, "site int, site_chrom string, low long, high long")
    reads = [r.asDict() | {"lc": r.qstart, "rc": r.rlen - r.qend} for r in frame(rows).collect()]
    near = lambda low, high, pad: [r for r in reads if r["pos"] < high + pad + 1 and r["ref_end"] > max(low - pad, 0)]
    breaks, ends, left, right, modes = {}, {}, {}, {}, {}
    for i, _, low, high in sites:
        for r in near(low, high, 5):
            size, plain = max(high - low, 5), r["alen"] == r["rlen"]
            alt = (r["rc"] > size and min(abs(r["ref_end"] - low), abs(r["ref_end"] - high)) <= 1) or (r["lc"] > size and min(abs(r["pos"] - low), abs(r["pos"] - high)) <= 1)
            add = lambda into, a, b: into.__setitem__((i, r["bam"]), tuple(x + y for x, y in zip(into.get((i, r["bam"]), (0, 0)), (int(a), int(b)))))  # noqa: B023, E731
            add(breaks, alt, not alt and plain and r["pos"] < low and r["ref_end"] > high)
            ends[i] = ends.get(i, 0) + int((r["lc"] > 5 and abs(r["pos"] - low) <= 1) or (r["rc"] > 5 and abs(r["ref_end"] - low) <= 1))
            ref = plain and r["pos"] < low - 5 and r["ref_end"] > high + 5
            for into, clip, edge in ((left, "lc", "pos"), (right, "rc", "ref_end")):
                add(into, not ref and r[clip] > 0 and abs(r[edge] - low) <= 5 + high - low, ref)
        at = [p for r in near(low, high, 20) for c, p in ((r["lc"], r["pos"]), (r["rc"], r["ref_end"])) if c > 0 and abs(p - low) <= 20]
        top = min(((-at.count(p), p) for p in set(at)), default=None)
        modes[i] = (top[1] if top and len(at) >= 2 and -top[0] >= 0.1 * len(at) else low, len(at))
    assert {(r.site, r.bam): (r.alt, r.ref) for r in be.break_counts(frame(rows), places(sites)).collect()} == breaks
    assert {r.site: r.n for r in be.endpoint_counts(frame(rows), places(sites)).collect()} == ends
    for side, want in (("left", left), ("right", right)):
        assert {(r.site, r.bam): (r.alt, r.ref) for r in be.junction_support(frame(rows), places(sites), side).collect()} == want
    assert {r.site: (r.junction, r.n) for r in be.junction_modes(frame(rows), places(sites), 20, 2, 0.1).collect()} == modes

    def met(*_):
        raise AssertionError("reads met sites")

    monkeypatch.setattr(be, "overlap_join", met)
    long, narrow = [r for r in rows if r[5] in ("60M", "7S60M", "60M9S", "6S40M12S")], [s for s in sites if s[3] - s[2] < 10]
    for out in (be.break_counts(frame(long), places(narrow)), be.endpoint_counts(frame(long), places(narrow)), be.junction_support(frame(long), places(narrow), "left"), be.junction_modes(frame(long), places(narrow))):
        assert out.count() > 0


def test_equal_sequences_are_aligned_once(spark, tmp_path, monkeypatch):
    """copies of a query cost no alignments, and each gets its hit."""
    from strandloom.operators import consensus as cs

    log = tmp_path / "aligned"
    gapped, ungapped = cs._gapped, cs._ungapped

    def counted(hit):
        def run(q, t):
            with open(log, "a") as f:
                f.write("x")
            return hit(q, t)

        return run

    monkeypatch.setattr(cs, "_gapped", counted(gapped))
    monkeypatch.setattr(cs, "_ungapped", counted(ungapped))
    element = "ACGTTGCATCGATTACGGATCCAGTTACGCAT"
    queries = spark.createDataFrame([(i, element if i % 2 else element.lower()) for i in range(50)], "query_id int, seq string")
    library = spark.createDataFrame([("e", element)], "target_id string, seq string")
    assert {(r.query_id, r.strand, r.score) for r in cs.library_hits(queries, library).collect()} == {(i, "+", 64) for i in range(50)}
    assert len(log.read_text()) <= 2
    best = cs.ungapped_best(queries.crossJoin(library.withColumnRenamed("seq", "target")), "seq", "target").collect()
    assert {(r.query_id, r.strand, r.score) for r in best} == {(i, "+", 160) for i in range(50)} and len(log.read_text()) <= 4


def test_breakends_are_matched_across_blocks(spark):
    """a chromosome without a gap is no single task; what a block can't know is settled in the next turn."""
    rng = np.random.default_rng(4)
    rows = [(c, int(p), s, int(rng.integers(1, 4))) for c in ("1", "2") for s in ("left", "right") for p in rng.choice(1200, 500, replace=False)]
    ends = spark.createDataFrame(rows, "chrom string, breakpos long, side string, n_reads long")
    pairs = be.breakend_pairs(ends, 5).collect()
    used, want = set(), set()
    for r in sorted(pairs, key=lambda r: (-r.score, str(r.left_pos), str(r.right_pos))):
        l, t = (r.chrom, "left", r.left_pos), (r.chrom, "right", r.right_pos)
        if l not in used and t not in used:
            used |= {l, t}
            want.add(tuple(r))
    assert {tuple(r) for r in be.matched(ends, 5, 48).collect()} == want
    assert {tuple(r) for r in be.matched(ends, 5).collect()} == want


def test_split_reads_read_a_cigar_once_and_sort_no_qualities(spark):
    """filters on what a CIGAR says don't read it again, and the rank-sum statistic counts its ties."""
    frame = spark.createDataFrame([read()], READ).repartition(2)  # no local table, which would be computed while planning
    plan = rd.split_reads(rd.clipped(rd.with_alignment(frame)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and "array_sort(" not in plan
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("!5I"), k)) for k in (1, 2, 3, 10, 40) for _ in range(8)] + ["II", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").select("i", rd.last_base_z(F.col("q")).alias("z")).orderBy("i").collect()
    for r, q in zip(got, texts):
        n = len(q or "")
        want = 0.0
        if n > 1 and len(set(q)) > 1:
            m, ties = n - 1, sum(q.count(x) ** 3 - q.count(x) for x in set(q))
            u = sum(1 if x < q[-1] else 0.5 if x == q[-1] else 0 for x in q[:-1])
            want = abs((max(u, m - u) - m / 2 - 0.5) / ((1 - ties / (n**3 - n)) * m * (m + 2) / 12) ** 0.5)
        assert abs(r.z - want) < 1e-9
