"""Benchmark decontamination.

The windows of ten benchmark words are hashed into a table that every task holds; the words of each document are
scanned once, all windows whose hash is in the table are verified against the words themselves, and what remains
marks the document's words as hit. Then hit documents or the hit passages are removed.

The table is a few arrays: the benchmark's words as bytes, and for each distinct window its hash, its place in them and
its items. It is built once, in the driver, and broadcast while the benchmark's bytes and words are within
MAX_BROADCAST_BYTES, which is measured first and bounds the table. Beyond that, a bitmap of fixed size of the windows'
hashes is broadcast; the documents' windows that it lets through meet the benchmark's in a shuffle join, on hash and
words, with the same result.

Defined cases: a null or empty text has no words; an item without words has no window; a null item_id is named
"null"; equal item_ids count once; repeated documents each get a row; an empty table gives no row or no hit; a column of
docs named as the output is replaced, others stay whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table
from .textbytes import ALNUM, LOWER, prefix_hash, span_hash, text_chunks, window_hash, word_spans

WINDOW = 10
#: Bound of the measured size of the broadcast table: a word's bytes, and ENTRY_BYTES for the window that begins with it.
MAX_BROADCAST_BYTES, ENTRY_BYTES = 64 << 20, 40
#: Log2 of the bits of the bitmap of hashes, 64 MB, and of those in one slice of it.
BITMAP_BITS, BITMAP_SLICE = 29, 15

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def _words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


class Windows:
    """Arrays of the distinct windows: words (bytes, each window's words one blank apart), and by length n the sorted
    hashes, the window's start and end in words, and items[first[k]:first[k + 1]] of window k, as numbers of names."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = sorted({"null" if item is None else str(item) for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts, found, at = [], [], 0
        for item, text in items:
            words = _words(text)
            if not words:
                continue
            joined = b" ".join(words)
            texts.append(joined)
            size = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(size + 1) - 1
            n = min(window, len(words))
            hashed = window_hash(span_hash(prefix_hash(np.frombuffer(joined, np.uint8)), ends - size, ends), n)
            found.append((np.full(len(hashed), n), hashed, at + (ends - size)[: len(hashed)], at + ends[n - 1 :], np.full(len(hashed), number["null" if item is None else str(item)])))
            at += len(joined)
        self.words = b"".join(texts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        if not found:
            return
        length, hashed, start, end, item = (np.concatenate(x) for x in zip(*found))
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            mine = mine[np.lexsort((item[mine], hashed[mine]))]
            h, s, e, i = hashed[mine], start[mine], end[mine], item[mine]
            # Windows of one hash are one if their words are; other words of that hash, if there are any, are moved behind.
            new = np.append(True, h[1:] != h[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            odd = np.array([k for k in np.flatnonzero(~new).tolist() if self.words[s[k] : e[k]] != self.words[s[first[k]] : e[first[k]]]], int)
            if len(odd):
                order = np.lexsort((i, [self.words[a:b] for a, b in zip(s, e)], h))
                h, s, e, i = h[order], s[order], e[order], i[order]
                new = np.array([k == 0 or h[k] != h[k - 1] or self.words[s[k] : e[k]] != self.words[s[k - 1] : e[k - 1]] for k in range(len(h))])
            once = np.append(True, (i[1:] != i[:-1]) | new[1:])
            heads = np.flatnonzero(new)
            self.by_length[n] = h[heads], s[heads].astype(np.int64), e[heads].astype(np.int64), i[once].astype(np.int32), np.append(np.cumsum(once)[heads] - 1, once.sum())

    def items_of(self, n: int, k: int, words: bytes) -> list[str]:
        """Items of the windows of these words, k the first of their hash's; none if only the hash is the same."""
        h, start, end, item, first = self.by_length[n]
        at = k
        while at < len(h) and h[at] == h[k]:
            if self.words[start[at] : end[at]] == words:
                return [self.names[i] for i in item[first[at] : first[at + 1]]]
            at += 1
        return []


class _Scanner:
    def __init__(self, windows: Windows):
        self.windows = windows

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, set[str], list[tuple[int, int]]]]:
        """For each row: words, hit words, items, and hit spans as bytes."""
        data = LOWER[data]
        rows = len(offsets) - 1
        starts, ends, row, _ = word_spans(data, offsets, ALNUM)
        per_row = np.bincount(row, minlength=rows)
        cover = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        if len(starts) and self.windows.by_length:
            raw, hashed = data.tobytes(), span_hash(prefix_hash(data), starts, ends)
            for n, (known, *_) in self.windows.by_length.items():
                seen = window_hash(hashed, n)
                at = np.searchsorted(known, seen)
                at[at == len(known)] = 0
                last = np.arange(len(seen)) + n - 1
                for i in np.flatnonzero((known[at] == seen) & (row[: len(seen)] == row[last])):
                    found = self.windows.items_of(n, int(at[i]), b" ".join(raw[s:e] for s, e in zip(starts[i : i + n], ends[i : i + n])))
                    if found:
                        cover[i] += 1
                        cover[i + n] -= 1
                        items[int(row[i])].update(found)
        hit = np.cumsum(cover)[:-1] > 0
        hits = np.bincount(row, weights=hit, minlength=rows).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(per_row)])
        for r in range(rows):
            spans: list[tuple[int, int]] = []
            if hits[r]:
                mine = hit[first[r] : first[r + 1]].astype(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]))) + first[r]
                spans = [(int(starts[a] - offsets[r]), int(ends[b - 1] - offsets[r])) for a, b in zip(edges[::2], edges[1::2])]
            yield int(per_row[r]), int(hits[r]), items.get(r, set()), spans


def digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _struct(results: list, kind: pa.DataType) -> pa.Array:
    rows = [{"n_words": n, "n_hit": h, "n_items": len(i), "items_sha256": digest(i), "contaminated": h > 0, "spans": [{"start": a, "end": b} for a, b in s]} for n, h, i, s in results]
    return pa.array(rows, kind)


_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs with a struct `out` of RESULT; spans are byte offsets in the text. Only item and item_text of benchmark are read."""
    bench = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("words"))
    docs = docs.drop(out)
    words = F.regexp_count(F.coalesce("words", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    measured = bench.agg(F.sum(F.octet_length("words")).alias("b"), F.sum(words).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if (measured.b or 0) + ENTRY_BYTES * ((measured.w or 0) + measured.n) > max_broadcast_bytes:
        return _hits_by_join(docs, bench, out, text, window)
    shared = docs.sparkSession.sparkContext.broadcast(Windows([(r.item, r.words) for r in bench.collect()], window))  # within the bound just measured

    def run(batches):
        scan = _Scanner(shared.value)
        for batch in batches:
            found = []
            for _, data, offsets in text_chunks(batch.column(text)):
                found += scan.scan(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, _struct(found, _KIND)], [*batch.schema.names, out])

    return docs.mapInArrow(run, _schema(docs, out))


def _schema(docs: DataFrame, out: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>"))])


def _bitmap(known: DataFrame) -> np.ndarray:
    """One bit for each value of the hashes' last BITMAP_BITS bits: slices are filled apart and meet in the driver, 64 MB in all."""

    def fill(batches):
        key, held = None, np.zeros(1 << BITMAP_SLICE - 3, np.uint8)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["i", "blob"])
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i != key:
                    if key is not None:
                        yield row()
                    key, held[:] = i, 0
                held[b >> 3] |= 1 << (b & 7)
        if key is not None:
            yield row()

    spot = F.col("h").bitwiseAND((1 << BITMAP_BITS) - 1)
    spots = known.select(F.shiftright(spot, BITMAP_SLICE).cast("int").alias("i"), spot.bitwiseAND((1 << BITMAP_SLICE) - 1).cast("int").alias("b")).distinct()
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in spots.repartition("i").sortWithinPartitions("i").mapInArrow(fill, "i int, blob binary").toLocalIterator():
        out[r.i << BITMAP_SLICE - 3 : (r.i + 1) << BITMAP_SLICE - 3] = np.frombuffer(r.blob, np.uint8)
    return out


def _hits_by_join(docs: DataFrame, bench: DataFrame, out: str, text: str, window: int) -> DataFrame:
    """The same by a shuffle join of those windows that the bitmap lets through. A result depends on the text alone, so equal texts are scanned once."""

    def item_windows(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                one = Windows([(item, text)], window)
                for n, (h, start, end, _, _) in one.by_length.items():
                    w = [one.words[s:e].decode("utf-8", "surrogatepass") for s, e in zip(start, end)]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(w, pa.string()), pa.array(one.names * len(h), pa.string())], ["h", "n", "w", "item"])

    known = cut(bench.mapInArrow(item_windows, "h long, n int, w string, item string").distinct())
    lengths = [r.n for r in known.select("n").distinct().collect()]  # at most `window` of them
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(known))

    def doc_windows(batches):
        for batch in batches:
            key = batch.column("k")
            for at, data, offsets in text_chunks(batch.column("t")):
                data = LOWER[data]
                starts, ends, row, _ = word_spans(data, offsets, ALNUM)
                raw, hashed = data.tobytes(), span_hash(prefix_hash(data), starts, ends)
                first = np.searchsorted(row, np.arange(len(offsets)))
                for n in lengths:
                    seen = window_hash(hashed, n)
                    ok = np.flatnonzero(row[: len(seen)] == row[np.arange(len(seen)) + n - 1]) if len(seen) else np.zeros(0, int)
                    spot = (seen[ok] & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                    ok = ok[bitmap.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 != 0]
                    for part in np.array_split(ok, len(ok) // 65536 + 1):
                        words = [b" ".join(raw[s:e] for s, e in zip(starts[i : i + n], ends[i : i + n])).decode("utf-8", "surrogatepass") for i in part]
                        r = row[part]
                        yield pa.RecordBatch.from_arrays(
                            [key.take(pa.array(r + at)), pa.array(seen[part].view(np.int64)), pa.array(np.full(len(part), n, np.int32)), pa.array(words, pa.string()), pa.array((part - first[r]).astype(np.int32)), pa.array((starts[part] - offsets[r]).astype(np.int32)), pa.array((ends[part + n - 1] - offsets[r]).astype(np.int32))],
                            ["k", "h", "n", "w", "pos", "s", "e"],
                        )

    def count_words(batches):
        for batch in batches:
            counts = [np.bincount(word_spans(LOWER[d], o, ALNUM)[2], minlength=len(o) - 1) for _, d, o in text_chunks(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.concatenate(counts).astype(np.int64))], ["k", "n_words"])

    texts = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("k"), F.col(text).alias("t")).dropDuplicates(["k"])
    seen = texts.mapInArrow(doc_windows, "k string, h long, n int, w string, pos int, s int, e int")
    found = seen.join(known, ["h", "n", "w"]).groupBy("k").agg(F.collect_set("item").alias("items"), F.sort_array(F.collect_set(F.struct("pos", "n", "s", "e"))).alias("at"))
    # A document's windows in order of their first word, merged into runs of hit words.
    merged = F.aggregate(
        "at",
        F.expr("cast(array() as array<struct<p:int,q:int,start:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["q"] >= x["pos"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["p"].alias("p"), F.greatest(F.element_at(acc, -1)["q"], x["pos"] + x["n"]).alias("q"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["e"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["pos"].alias("p"), (x["pos"] + x["n"]).alias("q"), x["s"].alias("start"), x["e"].alias("end"))))),
    )
    runs = found.select("k", "items", merged.alias("runs"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    result = texts.mapInArrow(count_words, "k string, n_words long").join(runs, "k", "left").select(
        F.col("k").alias(k := free_name(docs, "text_key")),
        F.struct(
            "n_words",
            F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["q"] - x["p"]), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")), 256).alias("items_sha256"),
            F.col("items").isNotNull().alias("contaminated"),
            F.coalesce(F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), none).alias("spans"),
        ).alias(out),
    )
    return docs.withColumn(k, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(result, k, "left").drop(k)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", **options) -> DataFrame:
    """docs without those hit (mode "document"), or with the hit passages cut from their texts (mode "span"). Clean rows stay as they are."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode}")
    text = options.get("text", "text")
    found = hits(docs, benchmark, out=(name := free_name(docs, "hits")), **options)
    if mode == "document":
        return found.where(~F.col(f"{name}.contaminated")).drop(name)
    raw, spans = F.encode(F.col(text), "utf-8"), F.col(name)["spans"]
    # What lies before, between and after the spans: substring on binary counts bytes.
    bounds = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])),
        F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(F.col(text)))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    rest = F.array_join(F.transform(bounds, lambda x: F.decode(F.substring(raw, x["a"] + 1, x["b"] - x["a"]), "utf-8")), "")
    return found.withColumn(text, F.when(F.col(f"{name}.contaminated"), rest).otherwise(F.col(text))).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[f"hits.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATTERN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, {_PATTERN}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, {_PATTERN}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
