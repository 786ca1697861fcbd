"""Operators against plain Python on small frames, boundaries included."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.operators import clusters as cl
from strandloom.operators import evidence as ev
from strandloom.operators import intervals as iv
from strandloom.sources import genomic as g


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, "c%d" % rng.randrange(2), s, s + rng.randrange(1, 40)) for i in range(60) for s in [rng.randrange(200)]]
    b = [(i, "c%d" % rng.randrange(2), s, s + rng.randrange(1, 40)) for i in range(60) for s in [rng.randrange(200)]]
    got = iv.overlap_join(spark.createDataFrame(a, "i int, chrom string, start long, end long"), spark.createDataFrame(b, "j int, b_chrom string, b_start long, b_end long"), 16).select("i", "j").collect()
    want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_overlap_of_very_long_and_short_intervals(spark):
    """Each meets at the coarser level, once; a long interval is few rows; null keys meet nothing and stay in the anti join."""
    rng = random.Random(7)
    span = lambda: (lambda s, n: (s, s + n))(rng.randrange(10**6), rng.choice([1, 5, 100, 3000, 10**5, 2 * 10**6]))
    a, b = [(i, "c", *span()) for i in range(80)], [(i, "c", *span()) for i in range(80)]
    left = spark.createDataFrame(a + [(80, None, 1, 5), (81, "c", None, 5)], "i int, chrom string, start long, end long")
    right = spark.createDataFrame(b + [(80, None, 1, 5)], "j int, b_chrom string, b_start long, b_end long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and x[3] > y[2])
    assert sorted(map(tuple, iv.overlap_join(left, right, 16).select("i", "j").collect())) == want
    small = right.where("b_end - b_start < 10")
    hit = {x[0] for x in a for y in b if y[3] - y[2] < 10 and x[2] < y[3] and x[3] > y[2]}
    assert sorted(r.i for r in iv.overlap_semi(left, small, 16).collect()) == sorted(hit)
    assert sorted(r.i for r in iv.overlap_anti(left, small, 16).collect()) == sorted(set(range(82)) - hit)


def test_stitched_windows_over_many_blocks(spark):
    rng = random.Random(8)
    rows = [("k%d" % rng.randrange(2), rng.randrange(400), i) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, p long, t int").repartition(7)
    for k in ("k0", "k1"):
        mine = sorted((p, t) for x, p, t in rows if x == k)
        got = {h: {r.t: r.x for r in cl.stitched(frame.where(F.col("k") == k), "k", ["p", "t"], F.col("p") + F.col("t"), h, "x", block=16).collect()} for h in ("sum", "max", "lag")}
        total, most, last = 0, None, None
        for p, t in mine:
            total += p + t
            assert (got["sum"][t], got["max"][t], got["lag"][t]) == (total, most, last)
            most, last = max(most or 0, p + t), p + t


def test_spans_decluster_and_depth(spark):
    rng = random.Random(9)
    rows = [(i, "c", s, s + rng.randrange(1, 40), rng.randrange(5)) for i in range(60) for s in [rng.randrange(900)]]
    frame = spark.createDataFrame(rows, "i int, chrom string, start long, end long, v int")
    want = [x[0] for x in rows if not any(y[4] > x[4] and y[2] < x[3] + 20 and y[3] > x[2] - 20 for y in rows)]
    assert sorted(r.i for r in iv.decluster_spans(frame, "v", 20, 16).collect()) == sorted(want)
    depth = {p: n for r in cl.depth_runs(frame, "chrom", "start", "end").collect() for p in range(r.start, r.end) for n in [r.depth]}
    assert depth == {p: n for p in range(1000) if (n := sum(x[2] <= p < x[3] for x in rows))}


def test_greedy_pairs_with_leftovers(spark):
    from strandloom.operators import pairing

    pairs = spark.createDataFrame([(1, "a", "x", 5.0), (1, "a", "y", 4.0), (1, "b", "x", 4.5), (2, "c", "z", 1.0)], "g int, l string, r string, s double")
    taken = pairing.greedy_pairs(pairs, ["g"], "l", "r", "s")
    assert {(r.l, r.r) for r in taken.collect()} == {("a", "x"), ("c", "z")}
    whole = pairing.with_leftovers(taken, pairs, pairs, "l", "r").select("l", "r").collect()
    assert {tuple(r) for r in whole} == {("a", "x"), ("c", "z"), ("b", None), (None, "y")}


def test_band_pairs_at_the_boundary(spark):
    l = spark.createDataFrame([("c", 0), ("c", 100), ("c", 250)], "chrom string, pos long")
    r = spark.createDataFrame([("c", 100), ("c", 101), ("d", 0), ("c", 150)], "r_chrom string, r_pos long")
    assert sorted((x.pos, x.r_pos) for x in iv.band_pairs(l, r, 100).collect()) == [(0, 100), (100, 100), (100, 101), (100, 150), (250, 150)]


def test_decluster_keeps_ties(spark):
    rows = spark.createDataFrame([(1, "c", 0, 5), (2, "c", 500, 5), (3, "c", 900, 4), (4, "c", 1001, 3)], "id int, chrom string, pos long, v int")
    assert sorted(r.id for r in iv.decluster(rows, "v", 500).collect()) == [1, 2]


def test_weighted_mean_is_zero_without_cover(spark):
    a = spark.createDataFrame([(1, "c", 10, 20), (2, "c", 90, 95)], "i int, chrom string, start long, end long")
    b = spark.createDataFrame([("c", 0, 30, 9.0), ("c", 9, 15, 1.0), ("c", 15, 30, 4.0)], "b_chrom string, b_start long, b_end long, score double")
    got = {r.i: r.mean_score for r in iv.weighted_mean(a, b, ["i"], 16).collect()}
    assert got == {1: (6 * 1.0 + 5 * 4.0) / 11, 2: 0.0}


def test_gap_chain_boundary(spark):
    rows = spark.createDataFrame([("c", 0, 10, 1), ("c", 260, 270, 2), ("c", 521, 530, 3)], "k string, s long, e long, t int")
    got = {r.t: r.chain for r in cl.gap_chain(rows, "k", "s", "e", 250, "t").collect()}
    assert got[1] == got[2] != got[3]


def test_median_cluster_equals_fold(spark):
    rng = random.Random(2)
    rows = [("k%d" % (i % 3), rng.randrange(3000)) for i in range(200)]
    want = []
    for k in {k for k, _ in rows}:
        now = []
        for p in sorted(p for x, p in rows if x == k):
            if now and abs(now[len(now) // 2] - p) > 30:
                want.append((k, now[0], now[-1], len(now)))
                now = []
            now.append(p)
        want.append((k, now[0], now[-1], len(now)))
    got = cl.median_cluster(spark.createDataFrame(rows, "k string, p long"), "k", "p", 30).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sweep_equals_fold(spark):
    rng = random.Random(3)
    rows = [("k%d" % (i % 2), s, s + rng.randrange(5, 60), rng.randrange(9)) for i in range(80) for s in [rng.randrange(1500)]]
    want = []
    for k in ("k0", "k1"):
        last = None
        for r in sorted(x for x in rows if x[0] == k):
            if last and r[1] < last[2] and r[2] > last[1]:
                last = r if r[3] > last[3] else last
            else:
                want += [last] if last else []
                last = r
        want.append(last)
    got = cl.sweep_longest(spark.createDataFrame(rows, "chrom string, start long, end long, size long"), "chrom").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_islands_and_chunks(spark):
    depth = spark.createDataFrame([("c", p, n) for p, n in ((1, 2), (2, 3), (3, 1), (4, 5), (6, 5))], "k string, p long, n long")
    # 3 is shallow, begins a run and 4 goes on with it; a run's last position must lie `length` behind its first.
    assert sorted((r.start, r.end) for r in cl.islands(depth, "k", "p", "n", 1, 1).collect()) == [(1, 3), (3, 5)]
    assert cl.islands(depth, "k", "p", "n", 1, 2).count() == 0
    got = cl.chunks(spark.createDataFrame([("a", 10), ("b", 5)], "n string, size long"), "n", "size", 2).collect()
    assert sorted(map(tuple, got)) == [(0, "a", 0, 8), (1, "a", 8, 10), (1, "b", 0, 5)]


def test_sequence_functions(spark):
    s = F.col("s")
    assert one(spark, sq.reverse_complement(s), s="ACgtNR") == "YNacGT"
    assert one(spark, sq.poly_a_fraction(s), s="AATG") == 0.5
    assert one(spark, sq.poly_a_fraction(s), s="") == 0.0
    assert one(spark, sq.longest_run(s, "A"), s="caaAAtAA") == 4
    assert one(spark, sq.locate_first(s, F.lit("")), s="abc") == (0, 0)
    assert one(spark, sq.locate_last(s, F.lit("ab")), s="abxab") == (3, 5)
    assert one(spark, sq.locate_first(s, F.lit("zz")), s="abc") is None
    assert one(spark, sq.locate_last(s, F.lit("aa")), s="aaa") == (0, 2) and one(spark, sq.locate_last(s, F.lit("x")), s="abc") is None
    assert one(spark, sq.poly_a_fraction(s), s="aAtg") == 0.5
    assert one(spark, sq.oriented(s, F.lit("GT")), s="TTACTT") == "AC"
    assert one(spark, sq.genotype(F.lit(20), s), s=0.5) == "0/1"
    assert one(spark, sq.genotype(F.lit(9), s), s=0.5) == "./."
    assert one(spark, sq.genotype(F.lit(20), s), s=1.0) == "0/0"
    assert one(spark, sq.swap_strand(s), s="+") == "-"
    assert one(spark, sq.touches_end(F.array(F.struct(F.lit(3).alias("start"), F.lit(7).alias("end"))), s), s=10) is False


def test_quality_trim(spark):
    values = F.array(*[F.lit(float(x)) for x in (9, 9, 9, 9, 0, 0, 0, 0, 0)])
    assert spark.range(1).select(sq.quality_trim_at(values).alias("x")).first().x == 2
    assert spark.range(1).select(sq.quality_trim_at(F.array(F.lit(1.0), F.lit(1.0))).alias("x")).first().x is None


def test_reasons(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    tests = {"Low": F.col("x") < 3, "Odd": F.col("x") == 1, "High": F.col("x") > 8}
    assert [r[0] for r in df.orderBy("x").select(ev.reasons(tests)).collect()] == ["Low,Odd", "PASS", "High"]
    assert [r[0] for r in df.orderBy("x").select(ev.first_reason(tests)).collect()] == ["Low", None, "High"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ALU:AluY some text\nACGT\nAC GT\n>plain\nTT\n")
    got = {r.seq_id: (r.superfamily, r.subfamily, r.seq) for r in g.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"ALU:AluY": ("ALU", "AluY", "ACGTACGT"), "plain": ("plain", None, "TT")}
    (tmp_path / "a.bed").write_text("#x\nchr1\t5\t9\n")
    assert [tuple(r) for r in g.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9)]
    (tmp_path / "a.fai").write_text("c1\t1000000\t1\nc2\t1000001\t1\n")
    assert [r.chrom for r in g.read_contigs(spark, str(tmp_path / "a.fai")).collect()] == ["c2"]
    (tmp_path / "a.psl").write_text("\t".join("9 0 0 0 0 0 0 0 + q 20 0 9 chr4 99 30 10 2 4,5, 0,4, 20,10,".split()) + "\n")
    r = g.read_psl(spark, str(tmp_path / "a.psl")).first()
    assert (r.tname, r.tstart, r.tend, [tuple(b) for b in r.blocks]) == ("4", 10, 30, [(10, 15), (20, 24)])
    (tmp_path / "a.out").write_text("   SW perc\nscore x\n\n  463 1.3 0.6 1.7 chr1 10001 10468 (249) C AluY SINE/Alu 1 2 (3) 1\n")
    assert [tuple(r) for r in g.read_repeats(spark, str(tmp_path / "a.out")).collect()] == [("1", 10001, 10468, "SINE/Alu", "AluY", "-")]


def test_stream_sessions_equal_batch(spark, tmp_path):
    from strandloom.streaming.sessions import session_counts

    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = session_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "6 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sessions_out").collect())) == sorted(map(tuple, session_counts(batch, "6 hours").collect()))


def test_spans_decluster_without_pairs(spark, monkeypatch):
    """spans over several blocks, empty ones, and equal values, against plain loops; no join of spans with spans is made."""
    rng = random.Random(4)
    rows = [(i, "c", s, s + rng.choice([0, 1, 7, 40, 3000]), rng.choice([0.5, 1.5, 2.5])) for i in range(120) for s in [rng.randrange(9000)]]
    frame = spark.createDataFrame(rows, "i int, chrom string, start long, end long, v double")
    want = [x[0] for x in rows if not any(y[4] > x[4] and y[2] < x[3] + 3 and y[3] > x[2] - 3 for y in rows)]

    def met(*_):
        raise AssertionError("spans met spans")

    monkeypatch.setattr(iv, "overlap_join", met)
    assert sorted(r.i for r in iv.decluster_spans(frame, "v", 3, 1024).collect()) == sorted(want)


def test_a_mean_at_the_cutoff_is_not_over_it(spark):
    """tenths that sum to a little more than their mean in doubles."""
    from strandloom.operators import filters as fl

    rows = spark.createDataFrame([(1, "c", 10, 20), (2, "c", 30, 40)], "i int, chrom string, start long, end long")
    # 0.1 + 0.7 in doubles over 2 is just under 0.4, and 0.1 + 0.2 over 2 just over 0.15: both are at the cutoff.
    for values, cutoff in (((0.1, 0.7), 0.4), ((0.1, 0.2), 0.15)):
        scores = spark.createDataFrame([("c", 5, 25, values[0]), ("c", 6, 25, values[1]), ("c", 28, 45, 0.9)], "b_chrom string, b_start long, b_end long, score double")
        assert [r.i for r in fl.map_filter(rows, scores, ["i", "chrom", "start", "end"], 16, cutoff).collect()] == [2]


def test_equal_spans_meet_once(spark, monkeypatch):
    """copies of spans on either side don't reach the join, and each row gets its answer."""
    seen = []
    join = iv.overlap_join

    def counted(a, b, width):
        seen.append((a.count(), b.count()))
        return join(a, b, width)

    monkeypatch.setattr(iv, "overlap_join", counted)
    a = spark.createDataFrame([(i, "c", 10, 20) for i in range(30)], "i int, chrom string, start long, end long")
    b = spark.createDataFrame([("c", 5, 15, x, s) for x, s in (("q", 1.0), ("p", 4.0)) for _ in range(20)], "b_chrom string, b_start long, b_end long, label string, score double")
    assert {tuple(r) for r in iv.first_overlap(a, b, ["i"], 16).collect()} == {(i, 5, 15, "p") for i in range(30)}
    assert {(r.i, r.annotation) for r in iv.annotate(a, b, ["i"], 16).collect()} == {(i, "p;q") for i in range(30)}
    assert {tuple(r) for r in iv.weighted_mean(a, b, ["i"], 16).collect()} == {(i, 2.5) for i in range(30)}
    assert seen == [(1, 1), (1, 2), (1, 1)]


def _lists_met(monkeypatch):
    """Rows of both sides that meet, as they are counted."""
    met, seen = iv._met, []

    def counted(a, b, *rest):
        seen.append((a.count(), b.count()))
        return met(a, b, *rest)

    monkeypatch.setattr(iv, "_met", counted)
    return seen


def test_pairs_of_recurring_spans_meet_as_lists(spark, monkeypatch):
    """equal spans meet once and are laid out as all their pairs; long lists are dealt; copies of whole rows and very long spans count, nulls don't."""
    seen = _lists_met(monkeypatch)
    rng = random.Random(3)
    spans = [(s, s + n) for s, n in ((5, 3), (7, 3), (7, 40), (300, 5), (0, 5000), (2000, 1))]
    a, b = ([(i // 2, rng.choice("cd"), *rng.choice(spans)) for i in range(300)] for _ in range(2))
    left = spark.createDataFrame(a + [(900, None, 1, 5), (901, "c", None, 5)], "i int, chrom string, start long, end long")
    right = spark.createDataFrame(b + [(900, None, 1, 5)], "j int, b_chrom string, b_start long, b_end long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])
    got = iv.overlap_pairs(left, right, 16)
    assert got.columns == left.columns + right.columns and sorted((r.i, r.j) for r in got.collect()) == want
    assert all(n <= 13 for n in seen[0])
    monkeypatch.setattr(iv, "LISTED", 4)
    assert sorted((r.i, r.j) for r in iv.overlap_pairs(left, right, 16).collect()) == want
    assert all(n > 25 for n in seen[1])
    bare = iv.overlap_pairs(left.drop("i"), right.drop("j"), 16)
    assert bare.count() == len(want) and iv.overlap_pairs(left.limit(0), right, 16).count() == 0


def test_ids_of_equal_span_meet_once(spark, monkeypatch):
    """copies of ids don't reach the join, and each still gives a row."""
    seen = _lists_met(monkeypatch)
    rows = spark.createDataFrame([(1, "c", 10, 20, "old"), (2, "c", 90, 99, "old")], "i int, chrom string, start long, end long, uuid string")
    ids = spark.createDataFrame([("c", 5, 15, u) for u in "xyyz"] * 10, "b_chrom string, b_start long, b_end long, b_uuid string")
    got = iv.replace_ids(rows, ids, "uuid", 16)
    assert got.columns == rows.columns and Counter(map(tuple, got.collect())) == {(1, "c", 10, 20, "x"): 10, (1, "c", 10, 20, "y"): 20, (1, "c", 10, 20, "z"): 10}
    assert seen == [(2, 1)]
