"""Each operator against brute force or a round trip on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import html as entities
import random
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import chat, components, decontaminate, html_text, lm_score, media, mixing, pii, quality, simhash, warc

WORDS = "alpha beta gamma delta Épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("hits", "score", "fp", "h", "spans", "candidates", "media", "text_hash", "mix_topic", "mix_kept", "no_id", "pii_text", "Score")


def texts():
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = make(60)
    out = [None, "", "   ", "one", "two words", base, base, base + " extra", make(30), "x" * 5000, make(4000), "a b c d e f g h i j", "mail bob@example.com or +1 (743) 555-3824, 10.0.0.1, 4111 1111 1111 1111 end"]
    return out + [make(rng.randrange(1, 80)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, "s%d" % (i % 2) if i % 5 else None, None) for i, t in enumerate(texts())]
    rows.append(rows[5])
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in CLASH if c != "Score"}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    t = texts()
    return spark.createDataFrame([(1, " ".join(t[5].split()[10:25])), (2, "Two WORDS"), (3, None), (4, ""), (5, "nothing like this stands anywhere in the texts of the table here"), (None, " ".join(t[10].split()[:12])), (1, "alpha beta not there")], "item_id long, text string")


def ref_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_decontamination(docs, bench, none, bound):
    items = [("null" if r.item_id is None else str(r.item_id), ref_words(r.text)) for r in bench.collect()]
    wins = {(i, tuple(w[k : k + min(10, len(w))])) for i, w in items if w for k in range(len(w) - min(10, len(w)) + 1)}

    def brute(t):
        w, hit, got = ref_words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    got.add(i)
        return len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()

    rows = decontaminate.hits(docs, bench, out="found", max_broadcast_bytes=bound).select("text", "found.*").collect()
    assert len(rows) == docs.count()
    assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute(r.text) for r in rows)
    assert any(r.contaminated for r in rows)
    clean = decontaminate.decontaminate(docs, bench, max_broadcast_bytes=bound)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in rows)
    cut = decontaminate.decontaminate(docs, bench, mode="span", max_broadcast_bytes=bound)
    assert cut.count() == len(rows) and not any(brute(r.text)[1] for r in cut.where("doc_id in (5, 10)").select("text").collect())
    assert decontaminate.hits(none, bench, out="found", max_broadcast_bytes=bound).count() == 0
    assert not decontaminate.hits(docs, bench.where("false"), out="found", max_broadcast_bytes=bound).where("found.contaminated").count()


def test_mixing(docs, none):
    mixed = mixing.mix(docs.drop("mix_topic", "mix_kept"), budget=0.5)
    rows = mixed.collect()
    tokens = sum(r.mix_tokens for r in rows)
    assert tokens == sum(len((r.text or "").split()) for r in rows)
    assert abs(sum(r.mix_tokens * r.mix_probability for r in rows) / tokens - 0.5) < 1e-6
    assert len(rows) == docs.count() and sorted(map(str, mixed.collect())) == sorted(map(str, rows))
    a, b = (mixing.mix(docs, rounds=2, max_cells=m) for m in (0, 1000))
    assert np.allclose(sorted(r._mix_probability if "_mix_probability" in r else r.mix_probability for r in a.collect()), sorted(r.mix_probability for r in b.collect()))
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("most", [mixing.MAX_CELLS, 0])
def test_mixing_keeps_languages_without_a_target(spark, most):
    """All four named languages occur; null and a fifth have their natural share, not none."""
    langs = ["en", "de", "fr", "es", None, "it"]
    docs = spark.createDataFrame([(i, "w " * 20, langs[i % 6], "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(docs, budget=0.2, max_cells=most, rounds=3).collect()
    mass = {x: sum(r.mix_tokens * r.mix_probability for r in rows if r.lang == x) for x in langs}
    assert abs(mass[None] - mass["it"]) < 1e-6 and abs(mass[None] / sum(mass.values()) - 1 / 6) < 1e-6
    assert abs(mass["en"] / mass["de"] - 0.55 / 0.15) < 1e-6
    assert {r.lang for r in rows if r.mix_kept} == set(langs)


def test_raking_meets_the_targets():
    cells = [(s, l, "t") for s in "ab" for l in ("en", "de")]
    w = mixing.rake(cells, np.array([10, 20, 30, 40]), [{"a": 0.5, "b": 0.5}, {"en": 0.7, "de": 0.3}, {"t": 1.0}])
    assert abs(w[0] + w[1] - 0.5) < 1e-9 and abs(w[0] + w[2] - 0.7) < 1e-9
    p = mixing.probabilities(w, np.array([10, 20, 30, 40]), 0.9)
    assert (p <= 1).all() and abs((p * [10, 20, 30, 40]).sum() - 90) < 1e-9


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        return all(int(x) <= 255 for x in m.split(".")) if k == "ip" else 8 <= len(d) <= 15 if k == "phone" else True

    return [(k, m.start(), m.end()) for k in FORMS for m in re.finditer(FORMS[k], t or "") if good(k, m[0])]


def test_pii(spark, docs, none):
    rng = random.Random(9)
    odd = ["a@b.c_x@d.e@f.g h%@i-.j", "1.2.3.4.5.6.7.8 256.1.1.1 0.00.000.255", "4111-1111 1111 1111-2", "+1+12345678 +1((((( +49 (0)30 1234567 5", "é" * 30 + "x@y.zz", "@.@.a@b", "a" * 50000, "1 " * 20000, 'token = "abcdef0123456789"', "call (743) 555-3824 now"]
    odd += ["".join(rng.choice("ab1290.@+- ()é_%") for _ in range(80)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd + texts())], "doc_id long, text string")
    for r in pii.candidates(frame).select("text", F.filter("candidates", lambda s: s["base"]).alias("b")).collect():
        got = [(pii.KINDS[s.kind], s.start, s.end) for s in r.b]
        assert sorted(got) == sorted(base_spans(r.text)), r.text[:200]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "bob@example.com" not in out.where("doc_id = 12").first().text and "[EMAIL]" in out.where("doc_id = 12").first().text
    assert pii.find(none, out="found").count() == 0 and pii.redact(docs.where("text is null")).first().text is None


def luhn_digits(rng, n, valid):
    """n digits that begin as card numbers do and whose checksum holds, or doesn't."""
    body = rng.choice(["4", "51", "37", "6"]) + "".join(rng.choice("0123456789") for _ in range(n))
    body = body[: n - 1]
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(body)))
    last = -total % 10
    return body + str(last if valid else (last + 1 + rng.randrange(9)) % 10)


def test_pii_precision_on_planted_decoys(spark):
    """By kind: spans that the plain forms miss are found, and decoys that look alike are left alone."""
    rng, rows, real, decoys = random.Random(9), [], {}, {}
    for k in range(400):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        kinds = {
            "card": (f"card {luhn_digits(rng, 15, True)}", f"order {luhn_digits(rng, 15 + k % 3, False)}"), "ip": (None, f"version {k % 9}.{k % 7}.{k % 5}" if k % 2 else f"address 10.{k}.{300 + k}.7"),
            "email": (f"write to {name} [at] mail{name} [dot] com", f"meet @ {name}"), "phone": (f"call ({200 + k}) 555-{1000 + k}", f"from {k} to {k + 1} in 20{k % 90 + 10}"),
        }
        for which, store in ((0, real), (1, decoys)):
            for kind, pair in kinds.items():
                if pair[which]:
                    text = f"Some text before, {pair[which]}; and after it."
                    store.setdefault(kind, set()).add(len(rows))
                    rows.append((len(rows), text))
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("spans")).collect()}
    for kind, ids in real.items():
        assert sum(f"{kind}:" in got[i] for i in ids) >= 0.95 * len(ids), kind
    for kind, ids in decoys.items():
        assert sum(f"{kind}:" in got[i] for i in ids) <= 0.02 * len(ids), kind


def test_quality_learns_and_scores_all(spark, docs, none):
    rng = random.Random(3)
    good, bad = (lambda: " ".join(rng.choice(WORDS) for _ in range(50))), (lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(50)))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    scored = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert all((scored[i] > 0.7) == bool(i % 3) for i in range(240))
    again = quality.score(docs, model, out="_score").collect()
    assert len(again) == docs.count() and all(0 <= r._score <= 1 for r in again)
    same = {}
    assert all(same.setdefault(r.text or "", r._score) == r._score for r in again)
    assert quality.score(none, model, out="_score").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.where("false")), out="_score").first()._score == 0.5
    assert quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("most", [lm_score.MAX_VOCAB, 5])
def test_lm_base_score(docs, none, most):
    train = docs.where("doc_id % 3 <> 1").select("text")
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    from collections import Counter

    c = Counter(w for r in train.collect() for w in tok(r.text))
    n, v = sum(c.values()), len(c)
    rows = lm_score.score(docs, train, max_vocab=most).collect()
    want = sorted((len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for w in (tok(r.text) for r in docs.collect()))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert lm_score.score(none, train).count() == 0


def test_lm_is_a_distribution():
    """Probabilities of all words of the code sum to 1 in any context, and so do those of all bytes and the stop."""
    counts = np.array([8, 4, 2, 16, 4, 9])
    seen = np.append(np.arange(256) % 7, 5)
    code = lm_score.Code(np.arange(6), counts, int(counts.sum()) + 12, seen)
    assert code.words == 8 and (code.symbol > lm_score.ESCAPE).all()
    rng = np.random.default_rng(1)
    tables = [rng.integers(-60, 60, n).astype(np.int8) for n in code.sizes()]
    # Leaves that no symbol has take a share of their own, so the sum is 1 only over a code's whole tree.
    for low, high, spelled in ((0, code.words, 0), (code.words, code.words + 257, 1)):
        symbols = np.arange(low, high)
        n = len(symbols)
        one = SimpleNamespace(symbol=symbols, row=np.arange(n), place=np.zeros(n, np.int64), spelled=np.full(n, spelled, np.uint8), hashed=[np.full(n, 77, np.uint32)] * 4)
        length = code.length[symbols].astype(int)
        used = sum(2.0**-x for x in length)
        p = np.exp(lm_score.Mixer(code, tables).run(one, n))
        assert (p > 0).all() and p.sum() <= 1 + 1e-5
        even = np.exp(lm_score.Mixer(code, [np.zeros_like(t) for t in tables]).run(one, n))
        assert abs(even.sum() - used) < 1e-3 and used <= 1


def test_lm_learns_within_short_texts():
    """A text of 300 symbols that contradicts the tables: weights and map follow it, whatever rows stand beside it."""
    counts = np.array([8, 4, 2, 16, 4, 9])
    code = lm_score.Code(np.arange(6), counts, int(counts.sum()) + 12, np.append(np.arange(256) % 7, 5))
    rng = np.random.default_rng(2)
    mixer = lm_score.Mixer(code, [rng.integers(-60, 60, n).astype(np.int8) for n in code.sizes()])

    def run(*texts):
        size = [len(t) for t in texts]
        n = sum(size)
        one = SimpleNamespace(symbol=np.concatenate(texts), row=np.repeat(np.arange(len(texts)), size), place=np.concatenate([np.arange(x) for x in size]), spelled=np.zeros(n, np.uint8), hashed=[np.full(n, 77, np.uint32)] * 4)
        return mixer.run(one, len(texts))

    symbols = min((np.full(300, x) for x in range(code.words)), key=lambda t: run(t[:1])[0])
    alone, start = run(symbols)[0], run(symbols[:1])[0]
    assert alone > 0.9 * 300 * start
    assert abs(run(symbols[:40], symbols, symbols[::2])[1] - alone) < 1e-9
    # What comes later changes nothing before it.
    ends = [run(np.append(symbols[:100], x))[0] for x in range(code.words)]
    assert sum(np.exp(e - run(symbols[:100])[0]) for e in ends) <= 1 + 1e-5


def test_lm_tables_hold_all_training_rows(spark):
    """The texts that starting weights are fitted on, and all their copies, count in the tables that score."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(60)] + [None, ""]
    train = spark.createDataFrame([(t,) for i, t in enumerate(texts) for _ in range(1 + i % 4)], "text string")
    sample, rest = lm_score.mixing_sample(train)
    assert sample and rest.count() + sum(n for _, n in sample) == train.count()
    data = np.frombuffer("".join(f"{t or ''} " for (t,) in train.collect()).encode(), np.uint8)
    hashes, counts = np.unique(lm_score.token_spans(data, np.array([0, len(data)]))[0], return_counts=True)
    code = lm_score.Code(hashes, counts, int(counts.sum()) + 200, np.append(np.bincount(data, minlength=256), 200))
    want = [np.zeros(2 * n, np.uint32) for n in code.sizes()]
    for (t,) in train.collect():
        one = np.frombuffer((t or "").encode(), np.uint8)
        lm_score.count_bits(one, np.array([0, len(one)]), hashes, code, want)
    tables = lm_score.learned(train, hashes, code).tables
    assert all((tables[k] == lm_score.log_odds(want[k])).all() for k in (1, 2, 3))


def test_lm_learns_from_no_sample(docs, monkeypatch):
    """Nothing that scores comes from a part of the training rows: weights start the same for any corpus, and no sample is drawn."""

    def drawn(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(lm_score, "mixing_sample", drawn)
    train = docs.where("doc_id % 3 <> 1").select("text")
    assert all(r.score < 0 for r in lm_score.score(docs, train).collect())
    h = np.arange(6)
    code = lm_score.Code(h, np.array([8, 4, 2, 16, 4, 9]), 60, np.append(np.arange(256) % 7, 5))
    weights = [lm_score.learned(t, h, code).weights for t in (train, docs.select("text"))]
    assert (weights[0] == weights[1]).all() and (weights[0] == lm_score.Mixer(code, []).weights).all()


def test_lm_symbols_spell_rare_words():
    """Vocabulary words are one symbol; others are an escape, their bytes and a stop; each row ends."""
    words = b"alpha beta alpha beta alpha"
    h = np.unique(lm_score.token_spans(np.frombuffer(words, np.uint8), np.array([0, len(words)]))[0])
    code = lm_score.Code(np.sort(h), np.array([3, 2]), 9, np.append(np.ones(256, int), 2))
    data = b"Alpha xy BETA"
    s = lm_score.Symbols(np.frombuffer(data, np.uint8), np.array([0, 0, len(data)]), np.sort(h), code)
    known = [int(x) for x in s.symbol]
    assert known[0] == lm_score.END and s.row.tolist() == [0] + [1] * 7
    assert known[2:6] == [lm_score.ESCAPE, code.words + ord("x"), code.words + ord("y"), code.words + lm_score.STOP]
    assert {known[1], known[6]} == {2, 3} and known[7] == lm_score.END and s.place.tolist() == [0, *range(7)]


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Texts of a chain of words: the word before tells the next, which the base can't know."""
    rng = random.Random(8)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text():
        out = [rng.choice(WORDS)]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    rows = lm_score.score(docs.where("doc_id >= 300"), docs.where("doc_id < 300").select("text")).collect()
    assert sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


@pytest.mark.parametrize("ids", [[*range(1000), 1 << 62], [-(1 << 63), *range(7, 1007), (1 << 63) - 1], [5] * 300 + [None] * 300, [None] * 50, [9] * 50, []], ids=["outlier", "widest", "heavy", "null", "one", "empty"])
def test_warc_shards_are_ranges(spark, ids):
    records = spark.createDataFrame([(x, f"u{i}", 100, f"{i % 40:040d}") for i, x in enumerate(ids)], "page_id long, url string, size long, digest string")
    dealt, shards = warc.with_shards(records)
    rows = [(r.shard, r.page_id) for r in dealt.collect()]
    assert len(rows) == len(ids) and all(0 <= s < shards for s, _ in rows)
    assert sorted(r.shard for r in warc.with_shards(records.repartition(3))[0].collect()) == sorted(s for s, _ in rows)
    spans = sorted((min(x for s2, x in rows if s2 == s), max(x for s2, x in rows if s2 == s)) for s in {s for s, x in rows} if all(x is not None for s2, x in rows if s2 == s))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    largest = max((sum(s2 == s for s2, _ in rows) for s in {s for s, _ in rows}), default=0)
    assert largest <= max(60, len(ids) // 8)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "y" * 1200
    rows = [(1, "http://a/ b\r\nX: y", big), (7, None, big), (7, None, big), (3, "u", "small"), (4, "u", "small"), (None, "u", None), (9, "u", ""), (8, "ü", big + "é"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, roll_bytes=500).collect()
    got = sorted((tuple(r)[:5] for r in warc.read(spark, folder).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        peers = [x[0] for x in rows if x[2] == h and x[0] is not None]
        last = max(peers, default=None)
        revisit = len(b) >= 1000 and p != last
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    assert sum(r.records for r in manifest) == len(rows) and not list(tmp_path.glob("w/data/_*"))
    again = warc.write(pages.repartition(3), f"file://{tmp_path}/w2", roll_bytes=500).collect()
    assert sorted((r.file, r.sha256) for r in again) == sorted((r.file, r.sha256) for r in manifest)
    assert warc.read(spark, (warc.write(pages.where("false"), f"file://{tmp_path}/w3"), f"file://{tmp_path}/w3")[1]).count() == 0


def ref_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    data = docs.select("doc_id", "text").collect()
    fps = [ref_fingerprint(r.text) for r in data]
    comp = brute_components(fps)
    least = {c: min((data[i].doc_id for i in range(len(data)) if comp[i] == c and data[i].doc_id is not None), default=None) for c in set(comp)}
    want = sorted(((r.doc_id, f - (1 << 64) if f >> 63 else f, least[c]) for r, f, c in zip(data, fps, comp)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_links_find_every_pair(spark):
    """Planted fingerprints at distances 1 to 4, and a dense ball, against all pairs."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:25]:
        for d in (1, 2, 3, 4):
            for b in (s := rng.sample(range(64), d)):
                f ^= 1 << b
            fps.add(f)
            for b in s:
                f ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3))) for _ in range(120)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    got = links.collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in got)
    roots = {r.node: r.root for r in components.components(links).collect()}
    mine = {}
    for f in fps:
        mine.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    comp = brute_components(fps)
    want = {}
    for f, c in zip(fps, comp):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 160)}}


def test_media(docs, none):
    stored = media.store(docs, out="wav")
    for r in media.sniff(stored, "wav", out="seen").select("text", "wav", "seen").collect():
        raw = (r.text or "").encode()
        samples = bytes(media.wave_samples(memoryview(bytes(r.wav))))
        assert samples[: len(raw)] == raw and not any(samples[len(raw) :]) and len(samples) % 64 == 0 and samples
        assert r.seen.type == "audio/wav" and [tuple(x) for x in r.seen.found] == [("audio/wav", 0, len(r.wav))]
    assert media.store(none, out="wav").count() == 0


def test_carving_of_embedded_media(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    parts = [png, media.wave(b"\x80" * 64), gif, gzip.compress(b"hello" * 50), box.getvalue()]
    blob, want = b"junk RIFF %PDF- GIF89a \xff\xd8\xff", []
    for kind, part in zip(("image/png", "audio/wav", "image/gif", "application/gzip", "application/zip"), parts):
        want.append((kind, len(blob), len(part)))
        blob += part + b"between PK\x03\x04"
    frame = spark.createDataFrame([(bytearray(blob), "image/jpeg"), (bytearray(png), "image/jpeg"), (None, None)], "media binary, declared string")
    rows = media.sniff(frame, declared="declared").collect()
    assert [tuple(x) for x in rows[0].sniffed.found] == want and rows[0].sniffed.type is None
    assert (rows[1].sniffed.type, rows[1].sniffed.corrected) == ("image/png", True) and rows[2].sniffed.found == []
    carved = [bytes(r.carved) for r in media.embedded(media.sniff(frame).limit(1)).collect()]
    assert carved == parts


def test_html():
    rng = random.Random(4)
    for _ in range(50):
        blocks = [" ".join(rng.choice(WORDS + ["<b>x</b>y", "&amp;lt;", "a &lt; b"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))]
        body = "".join(f"<p>{b}\n </p>" if rng.random() < 0.7 else f"<p>{b}<br>" for b in blocks)
        page = f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav><!-- <p>no</p> --><article><h1>Head</h1>{body}<aside>Side</aside></article><div class='comments'><p>{'comment ' * 40}</p></div><form><label>Name</label></form><footer>F</footer></body></html>"
        want = " ".join(["Head", *(" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in blocks)])
        assert html_text.main_text(page) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    plain = "<body><div id=menu>Home</div><div class=text>" + "".join(f"<p>{'word ' * 30}</p><p>Short.</p>" for _ in range(3)) + "</div><div class='sidebar'><p>Other</p></div></body>"
    assert html_text.main_text(plain) == " ".join(["word " * 29 + "word", "Short."] * 3)


def test_html_finds_the_text_beside_a_marked_teaser():
    """An article element is one contribution to weight: it doesn't rule out a larger text, and small ones beside a large article go."""
    text = " ".join(["word " * 99 + "word"] * 5)
    page = "<body><article><p>Teaser card.</p></article><div>" + f"<p>{'word ' * 100}</p>" * 5 + "</div></body>"
    assert html_text.main_text(page).endswith(text)
    assert html_text.main_text("<body><article>" + f"<p>{'word ' * 100}</p>" * 5 + "</article><div><p>Other pages.</p></div></body>") == text


def test_html_reads_attributes_by_name_and_keeps_marked_parts_of_the_text():
    long = "word " * 60
    for inner in ('<section id="discussion"><p>Part.</p></section>', '<p id="legal">Part.</p>', '<div id="responses">Part.</div>', '<p style="overflow:hidden">Part.</p>', '<p title="hidden gems">Part.</p>', '<p data-hidden=1>Part.</p>', '<p><a href=x>Part.</a></p>', "<aside>a<br>b<br>c</aside><p>Part.</p><aside>a<br>b<br>c</aside>"):
        for tag in ("article", "div"):
            page = f"<body><nav>Menu</nav><{tag}><p>{long}</p>{inner}<p>{long}</p><p>A <span class=\"search-hit\">hit</span> here.</p></{tag}><footer>F</footer></body>"
            assert html_text.main_text(page) == f"{long}Part. {long}A hit here.", (tag, inner)
    for inner in ('<p hidden>No.</p>', '<p aria-hidden="true">No.</p>', '<div class="ad">No.</div>', '<div role=search>No.</div>'):
        assert html_text.main_text(f"<article><p>{long}</p>{inner}</article>") == long.strip()


PARAGRAPH = "Running text has quite a number of words in each of its paragraphs, as articles do, and then it has some more of them. " * 2


def div(text):
    return f"<div>{text}</div>"


@pytest.mark.parametrize("above,below", [("Home News Sport Culture Travel Shop Contact Login".split(), ["Imprint", "Privacy policy", "Terms of use", "Contact us", "About", "All rights kept"]), ([f"Cheap shoes {k}" for k in range(24)], [f"Cheap hats {k}" for k in range(24)])])
@pytest.mark.parametrize("size", [1, 5, 60])
def test_html_of_unmarked_pages(above, below, size):
    """No tag or name says what is text: only the distribution of lines does. Taking all that no tag rules out gives the menu and footer, too."""
    text = [f"{PARAGRAPH}{k}" for k in range(size)]
    page = "<body>" + "".join(map(div, [*above, *text, *below])) + "</body>"
    assert html_text.main_text(page) == " ".join(text)
    heading = "<body>" + "".join(map(div, above)) + "<h1>Title</h1>" + "".join(map(div, [*text, *below])) + "</body>"
    assert html_text.main_text(heading) == " ".join(["Title", *text])
    # Two stretches of text with a list of links between them.
    both = "<body>" + "".join(map(div, [*above, *text, *below, *above, *text, *below])) + "</body>"
    assert html_text.main_text(both) == " ".join([*text, *text])


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<noscript>", '<a "', "<a 'x\" ", "<!-- ", '<p class="', "&amp", "<template ", "</p", "<![CDATA[", "<div>", "</div>", "<"])
@pytest.mark.parametrize("end", ["", ">", '">'])
def test_html_of_broken_markup_takes_linear_time(piece, end):
    began = time.process_time()
    html_text.main_text(piece * 100_000 + end)
    assert time.process_time() - began < 3


def pieces_of_media(rng):
    page = lambda last: b"OggS\0" + bytes([4 * last]) + bytes(20) + b"\x02\x05\x03" + b"abcdefgh"
    gif = b"GIF89a\x01\0\x01\0\x00\0\0" + b"!\xfe\x03abc\0" + b",\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0;"
    return [page(0), page(1), gif, gif[:-1], gif[:20], media.wave(b"abc"), media.wave(b""), b"RIFF\x14\0\0\0WAVEfmt \0\0\0\0", b"abcd\0\0\0\0", b"abcd\x08\0\0\0", b"data\x01\0\0\0x\0", b"RIFF\x20\0\0\0AVI ", b"!\x01\x01", b"\0", b";", b"OggS", bytes(rng.randrange(256) for _ in range(rng.randrange(9)))]


def plain_media(raw, at):
    """The length of the medium at a place by walking its own chain from there, without anything shared."""
    b = raw[at:]
    if b[:4] == b"OggS":
        k = 0
        while k + 27 <= len(b) and b[k : k + 5] == b"OggS\0":
            n = b[k + 26]
            size = 27 + n + sum(b[k + 27 : k + 27 + n])
            if k + 27 + n > len(b) or k + size > len(b):
                return None
            if b[k + 5] & 4:
                return k + size
            k += size
        return None
    if b[:4] == b"RIFF":
        if len(b) < 20 or b[8:12] not in (b"WAVE", b"AVI ", b"WEBP"):
            return None
        end, k, seen = 8 + int.from_bytes(b[4:8], "little"), 12, set()
        if end > len(b):
            return None
        while k + 8 <= end:
            if not all(32 <= c <= 126 for c in b[k : k + 4]):
                return None
            seen.add(b[k : k + 4])
            size = int.from_bytes(b[k + 4 : k + 8], "little")
            k += 8 + size + size % 2
        return end if k in (end, end + 1) and seen and (b[8:12] != b"WAVE" or {b"fmt ", b"data"} <= seen) else None
    k = 13 + (3 << (b[10] & 7) + 1 if len(b) > 10 and b[10] & 128 else 0)
    while 13 <= len(b) and k < len(b):
        if b[k] == 0x3B:
            return k + 1
        if b[k] not in (0x21, 0x2C) or b[k] == 0x2C and k + 10 >= len(b):
            return None
        k += 2 if b[k] == 0x21 else 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 128 else 0)
        while k < len(b) and b[k]:
            k += b[k] + 1
        k += 1
    return None


def test_media_chains_are_those_of_each_beginning():
    rng = random.Random(8)
    for _ in range(300):
        raw = b"".join(rng.choice(pieces_of_media(rng)) for _ in range(rng.randrange(1, 30)))
        places = media._Places(raw)
        starts = [m.start() for m in re.finditer(b"OggS|RIFF|GIF89a", raw)]
        rng.shuffle(starts)
        for at in starts:
            check = media.MAGIC[next(m for m in media.MAGIC if raw.startswith(m, at))]
            found = check(places, at)
            assert (found and found[1]) == plain_media(raw, at), (raw, at)


@pytest.mark.parametrize("piece", [b"OggS\0" + bytes(21) + b"\0", b"GIF89a" + b"!" * 49, b"GIF89a" + bytes(4) + b"\0\0\0", b"RIFF\x7f\x7f\x01\0WAVEabcd\0\0\0\0", b"%PDF-1.4 %%EOF", b"PK\x03\x04", b"\x89PNG\r\n\x1a\n"])
def test_media_of_false_beginnings_take_linear_time(piece):
    blob, signatures = piece * (400_000 // len(piece)), media.automaton()
    began = time.process_time()
    media.carve(blob, signatures)
    assert time.process_time() - began < 6


def test_chat(spark):
    tricky = ["", None, "\\", "<|end|>\n", "a\\<|turn|>b", "<", "|x", "\\\\|", "<\\|end|>", "é<|text|>\n"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "assistant", "system"] * 2, tricky))]
    frame = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame)
    for r in done.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["size"]))).alias("loss")).collect():
        want = sorted(((t, a or "", x or "") for c, t, a, x in rows + rows[:2] if c == r.conv_id))
        assert [(x.role, x.content) for x in r.t] == [w[1:] for w in want]
        assert r.loss == [w[2] for w in want if w[1] == "assistant"]
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "i.png", None), (None, "then", None, None), ("audio", None, "a.wav", 2.0), None]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(frame, parts="parts").first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|<|image:0|>then<|audio:1|><|end|>\n<|turn|>assistant<|text|><|end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 576), ("audio", "a.wav", 52)] and r.expanded_tokens == 628
