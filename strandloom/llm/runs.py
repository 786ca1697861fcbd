"""Periodic runs of words: stretches that repeat with a period, found through a run-length grammar of the words.

Recompression: stretches of one symbol become blocks, then symbols are dealt into left and right ones and each left one with
a right one behind it becomes a pair, turn about, until one symbol is left. Equal stretches are cut alike but for their
edges, so the longest common extension of two places climbs from level to level, a step at each, until symbols
differ, and goes down again to the words. Places come from harmonic grids: a run of four periods q holds four
neighbouring multiples of q, at which words are equal. All places of a chunk of texts climb together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, table
from .textbytes import mix64, text_chunks

#: A run has LEAST words or more, and REPEATS periods or more.
LEAST, REPEATS = 6, 4
CHUNK_BYTES, PENDING = 1 << 19, 1 << 16
RUN = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Level:
    symbols: np.ndarray
    first: np.ndarray  # where each symbol's children begin in the level below, and behind the last one
    blocks: bool  # children are equal
    parent: np.ndarray | None = None  # in the level above


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A symbol from `fresh` on for each key, the same for equal keys; and the next free one."""
    known, names = np.unique(keys, return_inverse=True)
    return names + fresh, fresh + len(known)


def grammar(text: np.ndarray) -> list[Level]:
    """Levels from the text (whole numbers from 0 on, not empty) to a single symbol."""
    levels = [Level(text, np.arange(len(text) + 1), False)]
    fresh = int(text.max()) + 1

    def add(symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> None:
        below = levels[-1]
        below.parent = np.cumsum(begins) - 1
        levels.append(Level(symbols, np.append(np.flatnonzero(begins), len(begins)), blocks))

    while len(now := levels[-1].symbols) > 1:
        begins = np.append(True, now[1:] != now[:-1])
        if not begins.all():
            at = np.flatnonzero(begins)
            sizes, symbols = np.diff(np.append(at, len(now))), now[at]
            many = sizes > 1
            symbols[many], fresh = _named(symbols[many] * (len(now) + 1) + sizes[many], fresh)
            add(symbols, begins, True)
            continue
        heads, seed = np.zeros(0, bool), 0
        while not heads.any():
            left = (mix64(now.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
            heads = max(left[:-1] & ~left[1:], ~left[:-1] & left[1:], key=np.count_nonzero)
            seed += 1
        at = np.flatnonzero(heads)
        begins = np.ones(len(now), bool)
        begins[at + 1] = False
        symbols = now.copy()
        symbols[at], fresh = _named(now[at] * fresh + now[at + 1], fresh)
        add(symbols[begins], begins, False)
    return levels


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
    """How many symbols are the same from i and j on (way 1) or right before them (way -1). i and j differ pairwise; the
    text begins and ends with a symbol that occurs once."""
    begun = i if way > 0 else i - 1
    a, b = begun.copy(), j.copy() if way > 0 else j - 1
    parted = np.zeros(len(i), np.int64)
    going = np.arange(len(i))
    for k in range(len(levels) - 1):
        if not len(going):
            break
        here, first = levels[k], levels[k + 1].first
        x, y = a[going], b[going]
        p, q = here.parent[x], here.parent[y]
        # What is left of the symbol above from here on, and whether that is all of it.
        if way > 0:
            left, other, whole = first[p + 1] - x, first[q + 1] - y, (first[p] == x) & (first[q] == y)
        else:
            left, other, whole = x - first[p] + 1, y - first[q] + 1, (first[p + 1] - 1 == x) & (first[q + 1] - 1 == y)
        same = here.symbols[x] == here.symbols[y]
        step = np.where(~whole & same, np.minimum(left, other), 0)
        x, y = x + way * step, y + way * step
        up = whole | (same & (left == other))
        a[going], b[going] = x, y
        parted[going[~up]] = k
        going = going[up]
        a[going], b[going] = here.parent[x[up]], here.parent[y[up]]
    for k in range(int(parted.max(initial=0)), 0, -1):
        down = np.flatnonzero(parted >= k)
        first, below = levels[k].first, levels[k - 1].symbols
        x, y = a[down], b[down]
        sizes = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y]) if levels[k].blocks else 1
        x, y = (first[x], first[y]) if way > 0 else (first[x + 1] - 1, first[y + 1] - 1)
        step = np.where(below[x] == below[y], sizes, 0)
        a[down], b[down] = x + way * step, y + way * step
    return (a - begun) * way


def grid(text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each period q that fits REPEATS times into `longest` words, the multiples i of it with equal words at the next ones. In a
    run, words are the same for (REPEATS - 2) * q words from i on as q words later, of which a few are looked at."""
    for q in range(1, longest // REPEATS + 1):
        points = text[::q]
        equal = points[1:] == points[:-1]
        fits = equal[: len(equal) - REPEATS + 2].copy()
        for k in range(1, REPEATS - 1):
            fits &= equal[k : len(equal) - REPEATS + 2 + k]
        at = np.flatnonzero(fits) * q
        for ahead in {1, 2, 3, q // 2, q + q // 3} if q > 1 else ():
            if len(at) and ahead <= (REPEATS - 2) * q:
                at = at[text[at + ahead] == text[at + ahead + q]]
        if len(at):
            yield at, q


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, length, smallest period) of the runs of texts of numbers from 0 on, by text, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    # Each text stands between marks that occur once.
    laid = lambda which: np.concatenate([np.append(texts[t], top + 1 + k) for k, t in enumerate(which)] or [np.zeros(0, np.int64)])
    begins = np.cumsum(sizes + 1) - sizes - 1
    places = [(at.astype(np.int32), np.full(len(at), q, np.int32)) for at, q in grid(laid(range(len(texts))).astype(np.int32), int(sizes.max(initial=0)))]
    if not places:
        return none
    at, period = (np.concatenate(p) for p in zip(*places))
    owner = (np.searchsorted(begins, at, "right") - 1).astype(np.int32)
    own = at + (REPEATS - 1) * period < begins[owner] + sizes[owner]
    at, period, owner = at[own], period[own], owner[own]
    held = np.unique(owner)  # only texts with such places need a grammar
    if not len(held):
        return none
    levels = grammar(np.append(top, laid(held)))
    moved = np.zeros(len(texts), np.int64)
    moved[held] = np.cumsum(sizes[held] + 1) - sizes[held] - begins[held]
    found, turns = [], 0
    while len(at):
        # Places of one period that follow each other mostly lie in one run: the first of them is asked, and those that its answer
        # holds need not be. After some turns all that are left are asked.
        behind = np.append(False, (period[1:] == period[:-1]) & (at[1:] == at[:-1] + period[1:])) if turns < 4 else np.zeros(len(at), bool)
        heads, ends = np.flatnonzero(~behind), np.zeros(len(at), np.int64)
        for k in range(0, len(heads), PENDING):
            some = heads[k : k + PENDING]
            who, q = owner[some], period[some].astype(np.int64)
            i = at[some] + moved[who]
            back, on = extensions(levels, i, i + q, -1), extensions(levels, i, i + q, 1)
            length = back + on + q
            ends[some] = at[some] + on + q
            keep = length >= np.maximum(LEAST, REPEATS * q)
            found.append(np.unique(np.stack([who, i - back - moved[who] - begins[who], length, q])[:, keep], axis=1))
        left = behind & (at + (REPEATS - 1) * period >= ends[heads][np.cumsum(~behind) - 1])
        at, period, owner, turns = at[left], period[left], owner[left], turns + 1
    rows = np.unique(np.concatenate(found, axis=1), axis=1)
    # Multiples of a run's period give the same stretch again; the smallest comes first.
    new = np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))[: rows.shape[1]]
    rows = rows[:, new]
    who, start, length, q = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    return who, start, length, q


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs with the runs of each text's words (bytes other than space and 0x09 to 0x0D), by start and period, and the text
    without repeats: words joined by one space, less those that a run holds after its first period.

    A null or empty text has no runs and collapses to the empty text. A text is handled whole, with some hundred bytes for each of
    its words. Every row is handled by itself, so repeated rows give the same; columns named like the outputs are replaced.
    """
    docs = docs.drop(runs, collapsed)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(text), CHUNK_BYTES):
                blob, numbers, words, coded = data.tobytes(), defaultdict(), [], []
                numbers.default_factory = numbers.__len__  # a word's number is how many came before it
                for s, e in zip(offsets[:-1], offsets[1:]):
                    words.append(blob[s:e].split())
                    coded.append(np.fromiter(map(numbers.__getitem__, words[-1]), np.int64, len(words[-1])))
                drop, lists = {}, [[] for _ in words]
                for who, start, length, period in zip(*(c.tolist() for c in runs_of(coded))):
                    lists[who].append({"start": start, "length": length, "period": period})
                    drop.setdefault(who, np.zeros(len(words[who]), bool))[start + period : start + length] = True
                left = [b" ".join(w if k not in drop else [w[x] for x in np.flatnonzero(~drop[k])]).decode("utf-8", "surrogatepass") for k, w in enumerate(words)]
                part = batch.slice(at, len(words))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, kind), pa.array(left, pa.string())], [*part.schema.names, runs, collapsed])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(runs, T._parse_datatype_string(RUN)), T.StructField(collapsed, T.StringType())]))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs of which a tenth, by crc32 of the key, repeat a stretch of their words up to their end; a null key counts as empty text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    whole = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    g = F.floor(whole / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), F.lit(0))
    return docs.withColumn(text, F.when(remainder(F.col(key), 10) == 0, edited).otherwise(F.col(text)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
