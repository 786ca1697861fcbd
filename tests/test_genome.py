"""CIGAR walks, alignment to a genome and assembly against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.operators import assembly, mapping
from strandloom.operators.lineage import cut

LETTERS = "ACGT"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome_of(draw, n):
    return "".join(draw.choice(LETTERS) for _ in range(n))


def plain_pairs(cigar, pos, seq):
    out, q = [], 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                out.append((pos, q, seq[q]))
            pos, q = pos + (op in "MDN=X"), q + (op in "MIS=X")
    return out


def test_walks_and_target_sites(spark):
    draw, rows = random.Random(1), []
    for k in range(300):
        ops = [f"{draw.randint(1, 6)}{draw.choice('MM=XIDN')}" for _ in range(draw.randint(1, 5))]
        cigar = draw.choice(["", "3H"]) + draw.choice(["", "4S"]) + "".join(ops) + draw.choice(["", "2S"])
        seq = genome_of(draw, sum(int(n) for n, op in re.findall(r"(\d+)([MIS=X])", cigar)))
        rows.append((k, cigar, 100 + draw.randint(0, 9), seq, 95 + draw.randint(0, 30), 95 + draw.randint(0, 30)))
    rows += [(300, None, 5, "A", 1, 2), (301, "1M", None, "A", 1, 2), (302, "4S", 5, "ACGT", 0, 9)]
    frame = spark.createDataFrame(rows, "k int, cigar string, pos long, seq string, a long, b long")
    steps = cg.walk(F.col("cigar"), F.col("pos"))
    got = frame.select("*", cg.aligned_pairs(F.col("seq"), steps).alias("pairs"), cg.covers(steps, F.col("a")).alias("covers"), cg.query_at(steps, F.col("a")).alias("at"), cg.aligned_span(steps).alias("span"), cg.bases_over(F.col("seq"), steps, F.col("a"), F.col("b")).alias("over"), cg.counted_bases(F.col("seq"), steps, F.col("a"), F.col("b")).alias("counted")).collect()
    for r in got:
        if r.cigar is None or r.pos is None:
            assert r.pairs is None and r.counted is None and r.span is None
            continue
        pairs = plain_pairs(r.cigar, r.pos, r.seq)
        lead = int((re.match(r"(?:\d+H)?(\d+)S", r.cigar) or [0, 0])[1])
        assert [tuple(p) for p in r.pairs] == pairs
        assert r.covers == any(p == r.a for p, _, _ in pairs) and r.at == next((q for p, q, _ in pairs if p == r.a), None)
        assert (tuple(r.span) if r.span else None) == ((pairs[0][0], pairs[-1][0]) if pairs else None)
        assert r.over == "".join(c for p, _, c in pairs if r.a <= p < r.b)
        assert r.counted == "".join(r.seq[lead + k] for k, (p, _, _) in enumerate(pairs) if r.a <= p < r.b)
    two = frame.where("k < 300").alias("x").join(frame.where("k < 300").alias("y"), F.expr("x.k + 1 = y.k")).select(F.struct("x.pos", "x.cigar", "x.seq").alias("one"), F.when(F.col("y.k") % 9 > 0, F.struct("y.pos", "y.cigar", "y.seq")).alias("two"))
    for exact in (True, False):
        for r in two.select("*", cg.target_site(F.col("one"), F.col("two"), exact).alias("t")).collect():
            p, q = (plain_pairs(x.cigar, x.pos, x.seq) if x else [] for x in (r.one, r.two))
            low, high = (max(p[0][0], q[0][0]), min(p[-1][0], q[-1][0])) if p and q else (0, 0)
            assert (r.t is not None) == (high > low)
            if r.t and exact:
                assert tuple(r.t) == (low, high + 1, *("".join(c for a, _, c in x if low <= a <= high) for x in (p, q)))


def plain_score(query, target):
    """Best local score with affine gaps, cell by cell."""
    far, m, n, top = -(10**9), len(query), len(target), 0
    held, down = [0] * (n + 1), [far] * (n + 1)
    for i in range(1, m + 1):
        row, along = [0] * (n + 1), far
        for j in range(1, n + 1):
            down[j] = max(held[j] - mapping.OPEN - mapping.EXTEND, down[j] - mapping.EXTEND)
            along = max(row[j - 1] - mapping.OPEN - mapping.EXTEND, along - mapping.EXTEND)
            row[j] = max(0, held[j - 1] + (mapping.MATCH if query[i - 1] == target[j - 1] and query[i - 1] in LETTERS else mapping.MISMATCH), down[j], along)
            top = max(top, row[j])
        held = row
    return top


def score_of(hit, query, target):
    """What the alignment's own CIGAR adds up to, and its edits."""
    score, t, q, q_end, cigar, edits = hit
    total = seen = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            same = sum(a == b and a in LETTERS for a, b in zip(query[q : q + n], target[t : t + n]))
            total, seen, q, t = total + same * mapping.MATCH + (n - same) * mapping.MISMATCH, seen + n - same, q + n, t + n
        else:
            total, seen = total - mapping.OPEN - n * mapping.EXTEND, seen + n
            q, t = q + n * (op == "I"), t + n * (op == "D")
    assert q == q_end
    return total, seen


def test_banded_alignment_is_best_and_its_path_says_so():
    draw = random.Random(2)
    for _ in range(150):
        target = genome_of(draw, draw.randint(30, 120))
        start = draw.randint(0, 10)
        query = list(target[start : start + draw.randint(15, 80)])
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(len(query))
            query[k : k + draw.choice([0, 1, 1, 3])] = draw.choice(["", "N", "A", "GG", "TCA"])
        query = "".join(query) or "A"
        hit = mapping.banded(query, target, -len(query), len(target))
        want = plain_score(query, target)
        assert (hit[0] if hit else 0) == want
        if hit:
            assert score_of(hit, query, target) == (hit[0], hit[5])
            shift = start
            if shift + len(query) <= len(target):
                quick = mapping.placed(query, target, shift, shift)
                assert score_of(quick, query, target) == (quick[0], quick[5]) and quick[0] >= mapping.banded(query, target, shift - mapping.BAND, shift + mapping.BAND)[0]


def test_minimizers_of_tiles_are_those_of_the_contig(spark):
    draw = random.Random(3)
    contigs = [("a", genome_of(draw, 5000)), ("b", genome_of(draw, 700) + "N" * 40 + "A" * 60 + genome_of(draw, 300)), ("c", "ACG"), ("d", ""), ("e", None)]
    for window in (1, 8):
        got = Counter(tuple(r) for r in mapping.genome_index(spark.createDataFrame(contigs, "chrom string, seq string"), 256, window).collect())
        want = Counter((int(w), c, int(a), bool(t)) for c, s in contigs for w, a, t in zip(*mapping.minimizers_of(s or "", window)))
        assert got == want and max(got.values()) == 1
    words, _, _ = mapping.minimizers_of("A" * 200)
    assert len(words) == 0


@pytest.fixture(scope="module")
def planted():
    """Two contigs with an element of 400 bases 30 times, and reads of both strands with changes and gaps."""
    draw = random.Random(4)
    repeat, contigs = genome_of(draw, 400), {}
    for c in ("x", "y"):
        contigs[c] = "".join(genome_of(draw, 1500) + repeat for _ in range(15)) + genome_of(draw, 1500) + "A" * 80
    reads = []
    for k in range(400):
        c, n = draw.choice("xy"), draw.choice([60, 100, 250, 1200])
        at = draw.randint(0, len(contigs[c]) - n - 100)
        s = list(contigs[c][at : at + n])
        for _ in range(draw.choice([0, 1, 2, n // 40])):
            i = draw.randrange(12, len(s) - 12)
            kind = draw.random()
            s[i : i + (3 if kind < 0.15 else 1)] = "" if kind < 0.15 else "GAT" if kind < 0.3 else draw.choice([x for x in LETTERS if x != s[i]])
        minus = draw.random() < 0.5
        unique = sum(0 <= (at + i) % 1900 < 1500 for i in range(n)) >= 40
        reads.append((f"r{k}", turned("".join(s)) if minus else "".join(s), c, at, "-" if minus else "+", unique))
    return contigs, reads, repeat


def test_reads_come_back_to_their_places(spark, planted):
    contigs, reads, repeat = planted
    queries = spark.createDataFrame([(r[0], r[1]) for r in reads] + [("polya", "A" * 70), ("none", None), ("short", "ACGTAC"), ("other", genome_of(random.Random(9), 100)), ("split", contigs["x"][3000:3100] + turned(contigs["y"][5000:5090]))], "query_id string, seq string")
    genome = spark.createDataFrame(list(contigs.items()), "chrom string, seq string")
    rows = mapping.aligned(queries.repartition(3), genome).collect()
    best = {r.query_id: r for r in rows if r.part == 0}
    right = 0
    for name, seq, chrom, at, strand, unique in reads:
        r = best[name]
        own = seq if r.strand == "+" else turned(seq)
        hit = (r.score, r.pos, r.q_start, r.q_end, re.sub(r"\d+S", "", r.cigar), r.nm)
        assert score_of(hit, own, contigs[r.chrom]) == (r.score, r.nm)
        assert sum(int(n) for n, op in re.findall(r"(\d+)([MIS])", r.cigar)) == len(seq)
        good = (r.chrom, r.strand) == (chrom, strand) and abs(r.pos - r.q_start - at) <= 12
        right += good or not unique
        if unique and r.mapq >= 20:
            assert good
    assert right >= 0.99 * len(reads)
    assert not {"polya", "none", "short", "other"} & set(best)
    parts = sorted((r.chrom, r.pos, r.strand, r.q_start, r.q_end) for r in rows if r.query_id == "split")
    assert [p[:3] for p in parts] == [("x", 3000, "+"), ("y", 5000, "-")]
    # A read of the repeat alone stands in all its copies alike.
    one = mapping.aligned(spark.createDataFrame([("rep", repeat[50:350])], "query_id string, seq string"), genome).collect()
    assert [(r.chrom, r.mapq, r.score) for r in one] == [("x", 0, 300)]
    assert mapping.aligned(queries.limit(0), genome).collect() == []


def test_frequent_words_bring_no_pairs(spark):
    """A thousand reads of their own with a poly-A tail, on a genome of poly-A stretches: seeds are those of their own letters."""
    draw = random.Random(5)
    genome = "".join(genome_of(draw, 200) + "A" * 50 for _ in range(100))
    reads = [(k, genome[k * 10 : k * 10 + 60] + "A" * 40) for k in range(1000)]
    found = mapping.seeds(spark.createDataFrame(reads, "query_id long, seq string"), mapping.genome_index(spark.createDataFrame([("g", genome)], "chrom string, seq string")))
    assert found.groupBy("query_id", "at", "strand").count().agg(F.max("count")).first()[0] <= mapping.COMMON
    mine = found.where((F.col("ref") - F.col("at") == F.col("query_id") * 10) & (F.col("strand") == "+")).select("query_id").distinct()
    assert mine.count() == len(reads)


def plain_unitigs(words, k):
    """Walks over the graph of both orientations."""
    nodes = set(words) | {turned(w) for w in words}
    after = lambda w: [w[1:] + c for c in LETTERS if w[1:] + c in nodes]
    before = lambda w: [c + w[:-1] for c in LETTERS if c + w[:-1] in nodes]

    def step(w):
        a = after(w)
        return a[0] if len(a) == 1 and len(before(a[0])) == 1 and a[0] != turned(w) else None

    heads, seen, out = [], set(), set()
    back = {step(w): w for w in nodes if step(w)}
    heads = [w for w in nodes if w not in back]
    for start in sorted(heads) + sorted(nodes, key=lambda w: (min(w, turned(w)), w != min(w, turned(w)))):
        if start in seen:
            continue
        path, w = [start], step(start)
        seen.add(start)
        while w and w not in seen:
            seen.add(w)
            path.append(w)
            w = step(w)
        if start not in heads:  # a circle, which its reverse stands for too
            seen |= {turned(x) for x in path}
        text = path[0] + "".join(p[-1] for p in path[1:])
        out.add((min(text, turned(text)), len(path)))
    return out


def test_unitigs_are_the_walks_of_the_graph(spark):
    draw, reads = random.Random(6), []
    for g in range(8):
        text = genome_of(draw, draw.choice([12, 40, 200]))
        if g % 4 == 0:
            text = text + text[:10]  # a circle for words of up to 9 letters
        if g % 4 == 1:
            text = text[:20] + "ACGTTGCAACGT" + text[20:40] + "ACGTTGCAACGT" + text[40:]  # a repeat
        if g % 4 == 2:
            text += turned(text)  # a hairpin
        for _ in range(30):
            at = draw.randint(0, max(0, len(text) - 15))
            piece = text[at : at + 15]
            reads.append((g, turned(piece) if draw.random() < 0.5 else piece))
        reads.append((g, text))
    reads += [(50, "A" * 30), (51, None), (52, "ACG"), (53, "ACGNNACGTACGT"), (54, "acgtgcatgg")]
    frame = spark.createDataFrame(reads, "g int, seq string")
    k = 9
    counted = cut(assembly.words(frame, ["g"], k))
    held = {}
    for r in counted.collect():
        held.setdefault(r.g, {})[r.word] = r.n
    tally = Counter((g, min(w, turned(w))) for g, s in reads if s for w in (s.upper()[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set(LETTERS))
    assert {(g, w): n for g, ws in held.items() for w, n in ws.items()} == dict(tally)
    got = Counter((r.g, r.contig, r.n_words) for r in assembly.unitigs(counted, ["g"], k).collect())
    assert got == Counter((g, *u) for g, ws in held.items() for u in plain_unitigs(ws, k))
    assert assembly.unitigs(counted.limit(0), ["g"], k).collect() == []


def test_joined_contigs(spark):
    draw = random.Random(7)
    text = genome_of(draw, 300)
    rows = [(1, text[:180]), (1, text[140:]), (1, "ACGT"), (2, text[:100]), (2, text[150:]), (3, text), (4, text[:60]), (4, text[:60])]
    got = Counter(tuple(r) for r in assembly.rescued(spark.createDataFrame(rows, "g int, contig string"), ["g"]).collect())
    assert got - Counter((g, c, False) for g, c in rows) == Counter({(1, text, True): 1})
    assert assembly.joined_text(None, "ACGT") == (None, 0.0, 0)
    one, share, columns = assembly.joined_text(text[:180], text[140:])
    assert (one, share, columns) == (text, 1.0, 40)


def test_spans_look_up_realigned_reads_and_short_parts_are_cut_together(spark, monkeypatch):
    """spans against plain loops, and the words of many sequences from one pass."""
    import random

    from strandloom.operators import mapping
    from strandloom.operators import reads as rd

    rng = random.Random(3)
    rows = [("c", rng.randrange(300), "30M20S", "C" * 30 + "A" * 20, 0) for _ in range(80)]
    reads = rd.with_alignment(spark.createDataFrame(rows, "chrom string, pos long, cigar string, seq string, nm int"))
    spans = [(i, "c" if i % 5 else "d", s, s + rng.choice([0, 1, 30])) for i in range(40) for s in [rng.randrange(350)]]
    library = spark.createDataFrame([("e", "ACGTTGCATCGATTACGGATCCAGTTACGCAT")], "chrom string, seq string")
    got = {r.span_id: r.n for r in mapping.realigned_counts(spark.createDataFrame(spans, "span_id int, chrom string, start long, end long"), reads, library).collect()}
    assert got == {i: sum(c == "c" and e > s and p < e and p + 30 > s for _, p, *_ in rows) for i, c, s, e in spans}
    seqs = ["".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(rng.choice([0, 5, 15, 18, 40, 90]))) for _ in range(60)]
    for window in (1, 8):
        of, *found = mapping.minimizers_of_all(seqs, window)
        for i, seq in enumerate(seqs):
            assert [x[of == i].tolist() for x in found] == [x.tolist() for x in mapping.minimizers_of(seq, window)]


def test_chains_equal_a_loop_over_hits(spark):
    from itertools import groupby

    draw, hits = random.Random(5), set()
    for q in range(400):
        for _ in range(draw.choice([1, 1, 2, 3, 5])):
            chrom, strand, base = draw.choice("ab"), draw.choice("+-"), draw.randrange(3000)
            for _ in range(draw.choice([1, 1, 3, 8])):
                at = draw.randrange(86)
                hits.add((f"q{q}", 100, chrom, strand, base + at + draw.choice([0] * 9 + [2]), at))
    want = []
    for (query, size), rows in groupby(sorted(hits), key=lambda r: r[:2]):
        held = []
        for (chrom, strand), part in groupby(rows, key=lambda r: r[2:4]):
            stretches = [[]]
            for r in part:
                if stretches[-1] and r[4] - stretches[-1][-1][0] > mapping.GAP:
                    stretches.append([])
                stretches[-1].append(r[4:6])
            held += [(c[0], chrom, strand, *c[1:]) for s in stretches for c in mapping.chained(s)]
        want += [(query, size, k, c[0], c[-1], *c[1:-1]) for k, c in enumerate(mapping.chosen(held, size))]
    frame = spark.createDataFrame(sorted(hits), "query_id string, size long, chrom string, strand string, ref long, at long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in mapping.chains(frame).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(got) == Counter(want)
    assert mapping.chains(frame.limit(0)).collect() == []


def test_a_genome_derived_from_few_bytes_is_not_broadcast(spark):
    letters = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT")
    contigs = spark.range(20).groupBy((F.col("id") % 2).cast("string").alias("chrom")).agg(F.array_join(F.collect_list(letters), "").alias("seq"))
    queries = contigs.select(F.col("chrom").alias("query_id"), F.substring("seq", 101, 100).alias("seq"))
    plan = mapping.seeds(queries, mapping.genome_index(contigs))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.query_id, r.chrom, r.pos, r.cigar) for r in mapping.aligned(queries, contigs).collect()} == {(c, c, 100, "100M") for c in "01"}


def test_tables_filled_side_by_side_give_what_each_gives():
    draw, queries = random.Random(3), []
    for _ in range(200):
        target = genome_of(draw, draw.choice([60, 212]))
        query = list(target[40:140]) if draw.random() < 0.5 else list(genome_of(draw, 100))
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(query))
            query[at] = draw.choice(["A", "N", "CC", ""])
        low = draw.choice([40, 24, -10, 100])
        queries.append(("".join(query), target, low, low + draw.choice([0, 0, 3])))
    one = [mapping.placed(*q) for q in queries]
    assert mapping.all_placed(queries, 30) == [hit if hit and hit[0] >= 30 else None for hit in one]
