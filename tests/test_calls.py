"""Repair of orientation, duplicates in order, p-values, and operators on empty tables and names that clash."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.jobs import genome_queries
from strandloom.jobs.registry import QUERIES
from strandloom.operators import breakends, consensus, evidence, orientation, pairing, reads

DATA = "/root/testdata/sf0.001"


def preferred(a, b):
    return (a["be1"] != a["be2"] and b["be1"] == b["be2"]) or a["sr"] > b["sr"] or a["dr"] > b["dr"]


def plain_resolved(rows):
    known = {}
    for n, r in enumerate(rows):
        one, two = (r["chrom"], r["be1"]), (r["chrom"], r["be2"])
        if one not in known or preferred(r, rows[known[one]]):
            known[one] = known[two] = n
    return {rows[n]["n"] for n in known.values()}


def test_duplicates_go_as_in_a_loop(spark):
    rows = [r.asDict() for r in genome_queries._repeated(spark, DATA).orderBy("n").collect()]
    got = QUERIES["Q113_resolved_duplicates"](spark, DATA).collect()
    assert sorted(r.n for r in got) == sorted(plain_resolved(rows)) and len(got) < len(rows)
    draw = random.Random(1)
    rows = [{"n": k, "chrom": draw.choice("ab"), "be1": draw.randint(0, 60), "be2": draw.choice([None, 0, 5, 40]), "sr": draw.randint(0, 3), "dr": draw.randint(0, 3), "span_end": 1} for k in range(300)]
    for r in rows:
        r["be2"] = r["be1"] if r["be2"] is None else r["be1"] + r["be2"]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows] + [(999, None, 1, 1, 1, 1, 1), (998, "a", None, 1, 1, 1, 1)], "n long, chrom string, be1 long, be2 long, sr int, dr int, span_end int").repartition(5)
    out = pairing.resolved_duplicates(frame, "n")
    assert out.columns == frame.columns and sorted(r.n for r in out.collect()) == sorted(plain_resolved(rows))
    assert pairing.resolved_duplicates(frame.limit(0), "n").collect() == []


def test_orientation_of_missing_parts(spark):
    draw = random.Random(2)
    letters = "".join(draw.choice("ACGT") for _ in range(200))
    rows = [(1, "e", letters[100:160], letters[20:60] + letters[100:140], None, "", ""), (2, "unknown", letters[100:160], letters[20:60] + letters[100:140], None, "", ""), (3, "e", None, "", "", "", ""), (4, None, letters, letters, letters, letters, letters)]
    calls = spark.createDataFrame(rows, "UUID long, element string, site_seq string, Genomic_Consensus_5p string, Genomic_Consensus_3p string, Insert_Consensus_5p string, Insert_Consensus_3p string").withColumns({"Orient_5p": F.lit("x"), "Orient_3p": F.lit("x"), "Inversion": F.lit("x"), "five": F.lit(1)})
    elements = spark.createDataFrame([("e", letters[:80])], "element string, element_seq string")
    got = {r.UUID: (r.Orient_5p, r.Orient_3p, r.Inversion, r.five) for r in orientation.repaired(calls, elements).collect()}
    assert got == {1: ("+", "NA", "N", 1), 2: ("NA", "NA", "N", 1), 3: ("NA", "NA", "N", 1), 4: ("NA", "NA", "N", 1)}
    assert orientation.repaired(calls.limit(0), elements).collect() == []
    around = spark.createDataFrame([(1, "e", letters), (2, "e", letters[90:]), (3, "x", letters), (4, "e", None)], "UUID long, element string, around_seq string")
    assert [r.UUID for r in orientation.self_aligned(around, elements).collect()] == [1]


def test_p_values(spark):
    zs = [0.0, 0.1, 1.0, 1.96, 2.5, 5.0, 10.0, 25.0]
    frame = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in frame.select("z", sq.normal_tail(F.col("z")).alias("two"), sq.normal_tail(-F.col("z"), 1).alias("one")).collect():
        want = math.erfc(r.z / math.sqrt(2))
        assert abs(r.two - want) <= 1.2e-7 * want and abs(r.one - want / 2) <= 1.2e-7 * want
    quals = ["ABCDE", "EDCBA", "AAAA", "A", "", None, "ABCDEFGHIJ", "AABBC", "BACDB"]
    got = [r.p for r in spark.createDataFrame([(k, q) for k, q in enumerate(quals)], "k int, q string").orderBy("k").select(reads.last_base_p(F.col("q")).alias("p")).collect()]
    assert got[:7] == [2 / 5, 2 / 5, 1.0, 1.0, None, None, 2 / 10] and got[7] == 2 / 5 and 0 < got[8] <= 1


def test_breakends_with_their_consensus(spark):
    """Reads at one breakpoint, begun two bases apart, make the sequence that they are pieces of; depth beyond the bound costs nothing."""
    draw = random.Random(4)
    text = "".join(draw.choice("ACGT") for _ in range(200))
    rows = [("c", 100, "right", 50 + 2 * k, 0, text[2 * k : 2 * k + 60], "I" * 60) for k in range(30) for _ in range(5)]
    rows += [("c", 300, "left", 300, 5, "".join(draw.choice("ACGT") for _ in range(60)), "I" * 60) for _ in range(6)]  # nothing in common
    rows += [("c", 500, "left", 500, 5, text[:60], "I" * 60), ("d", 1, "left", 1, 0, "N" * 5 + text[:60], "I" * 65), ("d", 2, "left", 1, 0, "ACGT", "IIII"), ("d", 3, "left", 1, 0, None, None)]
    split = spark.createDataFrame(rows, "chrom string, breakpos long, side string, pos long, qstart int, seq string, qual string")
    ends = split.select("chrom", "breakpos", "side").distinct()
    for n in (1, 5):
        got = {(r.chrom, r.breakpos): (r.consensus, r.consensus_score) for r in breakends.with_consensus(ends, split.repartition(n)).collect()}
        assert got == {("c", 100): (text[:118], 1.0), ("c", 500): (text[:60], 1.0)}
    few = [consensus.sampled(split.repartition(n), ["chrom", "breakpos"], 3).where("breakpos = 100").collect() for n in (1, 7)]
    assert Counter(few[0]) == Counter(few[1]) and len({r.seq for r in few[0]}) == 3 and len(few[0]) == 15


def test_tails_bring_no_pairs(spark):
    """Reads and elements that share a tail of A only don't meet; a read of nothing but A meets every tail."""
    draw = random.Random(3)
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    elements = [(k, letters(150) + "A" * 40) for k in range(30)]
    rows = [(k, letters(60) + "A" * 40) for k in range(200)] + [(1000 + k, e[80:]) for k, e in elements] + [(5000, "A" * 60)]
    hits = consensus.library_hits(spark.createDataFrame(rows, "query_id long, seq string"), spark.createDataFrame(elements, "target_id long, seq string")).where("strand = '+'").collect()
    own = {(r.query_id, r.target_id) for r in hits if r.query_id < 5000}
    assert {(1000 + k, k) for k, _ in elements} <= own and len(own) < 60
    assert sum(r.query_id == 5000 for r in hits) == 30


def test_masks_without_mapped_reads_and_pairs_without_scores(spark):
    bins = spark.createDataFrame([("a", 0, 10), ("a", 10, 20)], "chrom string, start long, end long")
    none = spark.createDataFrame([], "chrom string, pos long")
    assert evidence.cpm_mask(none, bins, 10, F.lit(True), F.lit(True)).collect() == []
    pairs = spark.createDataFrame([(1, "l", "r", None), (1, "l", "s", 2.0)], "g int, l string, r string, s double")
    assert Counter(tuple(r) for r in pairing.greedy_pairs(pairs, ["g"], "l", "r", "s").collect()) == Counter([(1, "l", "s", 2.0)])


def test_best_ends_are_one_shuffle_of_hits(spark, monkeypatch):
    """hits aren't joined with themselves, tasks follow their number, copies change nothing, and the choice is that of a loop over each end."""
    from strandloom.operators import resolve

    rng = random.Random(8)
    hits = [(i, be, t, rng.randrange(30), rng.randrange(9), 20, 400, "ACGT" * rng.randrange(3, 9), "ACGT", 0.95) for i in range(40) for be in (1, 2) for t in ("A:1", "B:2", "C:3") if rng.random() < 0.6]
    frame = spark.createDataFrame(hits * 2, "ins long, be int, target_id string, score long, target_start int, target_alnsize int, target_seqsize int, query_align string, target_align string, pct double")
    ends = spark.createDataFrame([(i, 0.9 * (i % 2), 0.9 * (i % 3 == 0)) for i in range(40)], "ins long, be1_poly double, be2_poly double")
    monkeypatch.setattr(resolve, "ROWS", 10)
    out = resolve.best_ends(frame, ends)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and f"RepartitionByExpression [ins#" in plan and f", {-(-2 * len(hits) // 10)}" in plan

    def chosen(i):
        on = lambda be, t=None: min(((-h[3], h[2], h[7]) for h in hits if h[:2] == (i, be) and t in (None, h[2])), default=None)
        one, two = first = on(1), on(2)
        differ = None not in first and one[1] != two[1]
        if differ and one[0] < two[0]:
            other = on(2, one[1])
            two = other if other and other[0] - two[0] < (20 if i % 3 == 0 else 5) else two
        elif differ:
            other = on(1, two[1])
            one = other if other and other[0] - one[0] < (20 if i % 2 else 5) else one
        if differ:
            one, two = (one, on(2, first[0][1])) if one[0] < two[0] else (on(1, first[1][1]), two)
        return tuple(x and (x[1], -x[0]) for x in (one, two))

    got = {r.ins: tuple(x and (x.target_id, x.score) for x in (r.be1, r.be2)) for r in out.collect()}
    assert got == {i: chosen(i) for i in {h[0] for h in hits}}


def test_sites_of_few_bytes_are_not_broadcast(spark):
    from strandloom.operators import breakends as be

    reads = spark.range(300).selectExpr("'c' as chrom", "id * 7 % 900 as pos", "id * 7 % 900 + 60 as ref_end", "concat('b', id % 2) as bam", "0 as flag", "60 as mapq", "60 as alen", "if(id % 3 = 0, 0, 8) as qstart", "if(id % 3 = 0, 60, 68) as qend", "if(id % 3 = 0, 60, 68) as rlen")
    sites = spark.range(40).selectExpr("id as site", "'c' as site_chrom", "id * 21 as low", "id * 21 + id % 4 as high")
    both = be.junction_supports(reads, sites)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("at#" in line or "low#" in line)]
    for side in ("left", "right"):
        want = {(r.site, r.bam, r.alt, r.ref) for r in be.junction_support(reads, sites, side).collect()}
        assert {(r.site, r.bam, r[f"alt_{side}"], r.ref) for r in both.collect()} == want


def test_unlike_bases_between_good_ones_are_not_bridged(spark, tmp_path):
    """Parts whose letters behind the run of N meet the element's, or the site's, by chance (of 480,000 parts these six)."""
    import duckdb

    from strandloom.jobs.registry import ORACLE_SQL, QUERIES

    spark.createDataFrame([(p,) for p in (134376, 142132, 170439, 319019, 371460, 543724, 11, 13)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    name = "Q112_orientation_repair"
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == set(c.sql(ORACLE_SQL[name]).fetchall())


def test_dropped_stretches_equal_a_plain_search():
    import random

    from strandloom.operators import consensus as cs

    draw, pairs = random.Random(4), []
    for _ in range(300):
        t = "".join(draw.choice("ACGT") for _ in range(60))
        q = "".join(c if draw.random() < 0.6 else draw.choice("ACGTN") for c in t[draw.randrange(9) :][: draw.randrange(20, 50)])
        pairs.append((q, t))

    def plain(q, t, drop):
        best = (0, -1)
        for k in range(len(q) + len(t) - 1):
            now = peak = begin = same = 0
            for j, c in enumerate(q):
                at = k - len(q) + 1 + j
                hit = 0 <= at < len(t) and t[at] == c != "N"
                now, same = now + (cs.FLAT_MATCH if hit else cs.FLAT_MISMATCH), same + hit
                peak = max(peak, now)
                if now <= 0 or now < peak - drop:
                    now, peak, begin, same = 0, 0, j + 1, 0
                elif now > best[0]:
                    shift = at - j
                    best = (now, begin, j + 1, begin + shift, j + 1 + shift, same)
        return best if best[0] else None

    for drop in (8, 16, 30):
        for (q, t), hit in zip(pairs, cs.ungapped_hits(*map(list, zip(*pairs)), drop)):
            assert hit[0] == plain(q, t, drop)[0]
            assert sum(cs.FLAT_MATCH if a == b != "N" else cs.FLAT_MISMATCH for a, b in zip(q[hit[1] : hit[2]], t[hit[3] : hit[4]])) == hit[0]
