"""Order MinHash, hard negatives and periodic runs against plain Python, on whole tables and on awkward ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import negatives, order_minhash, registry, runs
from strandloom.llm.common import table

DATA = "/root/testdata/sf0.001"
AWKWARD = [(None, "a b", 1), (1, None, 2), (2, "", 3), (3, "x " * 40, 4), (3, "x " * 40, 4), (5, "é\U0001f600 " * 9 + "\x00", 5), (4, "a b c " * 3000, 6), (9, "no run here", 7), (1 << 62, "\n".join("q w e r".split() * 5), 8)]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, part int").withColumn("peek", F.lit("mine")).repartition(3)


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                out.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_collapsed(words, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def test_op13_of_all_documents(spark, documents):
    got = {r.doc_id: r for r in registry.QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert set(got) == {d for d, _ in documents}
    some = 0
    for doc_id, text in documents:
        words = plain_planted(doc_id, plain_words(text))
        found = plain_runs(words)
        some += bool(found)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        want += (hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want, doc_id
    assert some > 10


def test_op13_on_awkward_rows(spark, awkward):
    rows = runs.with_runs(awkward.withColumn("RUNS", F.lit(1))).collect()
    assert Counter((r.doc_id, r.text, r.part, r.peek) for r in rows) == Counter((d, t, p, "mine") for d, t, p in AWKWARD)
    for r in rows:
        found = plain_runs(plain_words(r.text))
        assert [(x.start, x.length, x.period) for x in r.runs] == found and r.collapsed == plain_collapsed(plain_words(r.text), found)
    assert runs.with_runs(awkward.limit(0)).collect() == []


def test_runs_of_random_words():
    draw = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(0, 6)):
            words = []
            while draw.random() < 0.85:
                words += [draw.randint(0, draw.choice([0, 1, 2, 20])) for _ in range(draw.randint(1, 9))] * draw.randint(1, 9)
                words = words[: len(words) - draw.choice([0, 0, 1, 2])]
            texts.append(words)
        got = [[] for _ in texts]
        for who, *found in zip(*(c.tolist() for c in runs.runs_of([np.array(t, np.int64) for t in texts]))):
            got[who].append(tuple(found))
        assert got == [plain_runs(t) for t in texts]


def test_grammar_extensions_are_exact():
    draw = random.Random(4)
    for _ in range(30):
        inner = [draw.randint(0, 2) for _ in range(draw.randint(2, 300))]
        text = np.array([9, *inner, 10])
        at = np.array([(i, j) for i in range(1, len(text) - 1) for j in range(1, len(text) - 1) if i != j][:4000])
        levels = runs.grammar(text)
        on, back = (runs.extensions(levels, at[:, 0], at[:, 1], w) for w in (1, -1))
        for (i, j), f, b in zip(at.tolist(), on.tolist(), back.tolist()):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            m = 0
            while min(i, j) - m > 0 and text[i - m - 1] == text[j - m - 1]:
                m += 1
            assert (f, b) == (n, m)


MASK = (1 << 64) - 1


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_fingerprint(text):
    m = order_minhash
    codes, seen, hashes, out = [ord(c) for c in text] + [0x110000] * max(0, m.K - len(text)), Counter(), [], ""
    for i in range(len(codes) - m.K + 1):
        word = 0
        for c in codes[i : i + m.K]:
            word = (word * 0xD6E8FEB86659FD93 + mix((c + 0x9E3779B97F4A7C15) & MASK)) & MASK
        word, key = mix(word), tuple(codes[i : i + m.K])
        hashes.append(mix((word + seen[key] * 0x9E3779B97F4A7C15) & MASK))
        seen[key] += 1
    for t in range(m.TUPLES):
        a = (mix(t + 1) >> 32) | 1
        taken = sorted(i for _, i in sorted(((h & 0xFFFFFFFF) * a & 0xFFFFFFFF, i) for i, h in enumerate(hashes))[: m.TUPLE])
        value = mix(t + (len(taken) << 8))
        for i in taken:
            value = mix((value * 0xD6E8FEB86659FD93 + hashes[i]) & MASK)
        out += f"{value >> 32:08x}"
    return out


def plain_neighbours(rows):
    rows = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    share = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / order_minhash.TUPLES
    prints, out = [plain_fingerprint(t) for _, t in rows], []
    for k, (key, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        other = plain_fingerprint(edited)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k], other, share(prints[k], other), share(prints[k], prints[(k + 1) % len(rows)])))
    return out


def test_op11_of_all_documents(spark, documents):
    got = [tuple(r) for r in registry.QUERIES["op11_order_minhash"](spark, DATA).collect()]
    short = [(k, (t or "")[:1500]) for k, t in documents]
    cut = table(spark, DATA, "documents").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    assert Counter(tuple(r) for r in order_minhash.neighbours(cut).collect()) == Counter(plain_neighbours(short))
    # On whole texts all but the fingerprints, which take the plain version minutes; and fingerprints by the library's own map.
    rows = sorted(documents)
    prints = {r.doc_id: r.fingerprint for r in order_minhash.with_fingerprint(table(spark, DATA, "documents")).collect()}
    assert len(got) == len(rows)
    for (doc_id, n, digest, own, other, near, after), (k, text), (k2, text2) in zip(sorted(got), rows, rows[1:] + rows[:1]):
        text, text2 = text or "", text2 or ""
        q = len(text) // 4
        assert (doc_id, n, own) == (k, len(text), prints[k])
        assert digest == hashlib.sha256((text[: len(text) - q] + text2[:q]).encode()).hexdigest()
        assert after == sum(own[i : i + 8] == prints[k2][i : i + 8] for i in range(0, len(own), 8)) / order_minhash.TUPLES
    assert np.mean([r[5] for r in got]) > 0.3 and np.median([r[6] for r in got]) < 0.05


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_op11_on_awkward_rows(spark, awkward, parts):
    short = awkward.withColumn("text", F.substring("text", 1, 2000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r) for r in order_minhash.neighbours(short).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(got) == Counter(plain_neighbours([(k, t[:2000] if t else t) for k, t, _ in AWKWARD]))
    assert order_minhash.neighbours(awkward.limit(0)).collect() == []
    one = order_minhash.neighbours(awkward.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_minhash_sees_order():
    words = [f"w{k}" for k in range(400)]
    (a, b), _ = order_minhash.fingerprints([" ".join(words), " ".join(words[200:] + words[:200])], [None, None], [0, 0])
    shuffled = random.Random(1).sample(words, 400)
    (_, c), _ = order_minhash.fingerprints([" ".join(words), " ".join(shuffled)], [None, None], [0, 0])
    assert (a == b).mean() < 0.75 and (a == b).mean() > (a == c).mean()


def test_likeness_in_sql(spark):
    docs = spark.createDataFrame([("same words here", "same words here", "others"), (None, "", "x")], "a string, b string, c string")
    for name in "abc":
        docs = order_minhash.with_fingerprint(docs, name, f"f{name}")
    assert [tuple(r) for r in docs.select(order_minhash.likeness("fa", "fb"), order_minhash.likeness("fa", "fc")).collect()] == [(1.0, 0.0), (1.0, 0.0)]


def test_strassen_is_exact():
    draw = np.random.default_rng(5)
    for n, k, m in ((1, 1, 1), (70, 33, 129), (64, 64, 64), (257, 64, 100), (17, 300, 40), (0, 5, 7)):
        for top in (3, 300, 1 << 20, 1 << 27):
            a, b = draw.integers(-top, top, (n, k)), draw.integers(-top, top, (k, m))
            assert (negatives.strassen(a, b) == a @ b).all()
    with pytest.raises(OverflowError):
        negatives.strassen(np.full((2, 2), 1 << 40), np.full((2, 2), 1 << 40))


def plain_negatives(rows, anchors, positives=5, most=10):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in sorted(set(anchors)):
        label, vector = min((la, v) for i, la, v in rows if i == a)
        scored = sorted(((-dot(vector, v), i, la) for i, la, v in rows), key=lambda r: r[:2])
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:positives]:
            window = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:most]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(window)]
    return out


@pytest.mark.parametrize("tile", [3, 64])
def test_negatives_with_ties_and_repeats(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "CANDIDATES", tile)
    monkeypatch.setattr(negatives, "ANCHORS", tile)
    draw = random.Random(6)
    # One label holds a third of the rows; scores tie often, some ids come twice, and some vectors are short.
    rows = [(k, 0 if draw.random() < 0.34 else draw.randint(-3, 20), [draw.randint(-2, 3) for _ in range(draw.choice([0, 4, 4, 4]))]) for k in range(200)]
    rows += rows[:9]
    frame = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(5)
    got = negatives.hard_negatives(frame.withColumn("slots", F.lit(1)), frame.where("id % 10 = 0"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_negatives(rows, [i for i, _, _ in rows if i % 10 == 0]))
    assert negatives.hard_negatives(frame, frame.limit(0)).collect() == [] == negatives.hard_negatives(frame.limit(0), frame.limit(0)).collect()


def test_whole_vectors(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (7, 2, [])]
    frame = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    assert [tuple(r) for r in negatives.whole_vectors(frame).orderBy("id").collect()] == [(1, 1, [128, -1]), (7, 2, [])]
