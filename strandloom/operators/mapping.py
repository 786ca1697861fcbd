"""Sequences aligned to a genome: minimizers, collinear chains of them, and banded alignments of what the chains point to.

The index of a genome is a table of words, and so are the words of the queries; they meet by a join on the word. A query's hits are
chained in one sorted stream, and a chain meets the piece of the genome under it by its tile. No step holds a genome, and none pairs
queries with all places of a repeat, but for those that lie in it altogether (see `seeds`).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import reverse_complement
from ..sources.alignments import fetch, pieces_of, tiles
from .clusters import running
from .lineage import written
from .names import free
from .reads import clipped_part

#: Letters of a word, words of which the least counts, places of a word up to which it always counts, and words that count whatever their places.
WORD, WINDOW, COMMON, RARE = 15, 8, 64, 3
#: Bases between hits of a chain, earlier hits looked at, band beside a chain, and bases beside it that are fetched.
GAP, BEFORE, BAND, PAD, TILE = 500, 64, 32, 24, 1 << 12
#: Letters of sequences, and cells of a row of alignments' tables, that are looked at together.
LETTERS, CELLS = 1 << 19, 1 << 14
# Scores of the aligner whose place this takes.
MATCH, MISMATCH, OPEN, EXTEND, LEAST = 1, -4, 6, 1, 30
_U = np.uint64
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = np.tile(np.arange(4, dtype=np.uint8), 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def minimizers_of_all(seqs: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the sequence, word, place, whether it stands on the other strand) of the least words of `window` in a row, of both strands' words the lesser one.
    Words with other letters than ACGT, equal to their reverse, or of one or two letters turn about (poly-A) are none. Sequences are looked at end to end,
    with a letter between them that no word holds."""
    codes = _CODE[np.frombuffer("\n".join(seqs).encode("ascii", "replace"), np.uint8)]
    n = len(codes) - WORD + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    here, other, good = np.zeros(n, _U), np.zeros(n, _U), np.ones(n, bool)
    for j in range(WORD):
        c = codes[j : j + n]
        good &= c < 4
        here = (here << _U(2)) | c.astype(_U)
        other |= (_U(3) - np.minimum(c, 3).astype(_U)) << _U(2 * j)
    turning = np.append(True, True)
    if len(codes) > 2:
        turning = codes[2:] != codes[:-2]
    changes = np.append(0, np.cumsum(turning))
    last = np.minimum(np.arange(n) + WORD - 2, len(changes) - 1)
    good &= (here != other) & (changes[last] - changes[: len(last)] > 0)
    order = np.where(good, _mixed(np.minimum(here, other) + _U(1)), ~_U(0))
    sizes = np.array([len(x) for x in seqs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.maximum(sizes - WORD + 1, 0)
    if window == 1:
        least = np.flatnonzero(good)
    else:
        # Windows within a sequence; one with fewer words than a window has them all in one.
        kept = [start + order[start : start + w].argmin(keepdims=True) for start, w in zip(starts[(words > 0) & (words < window)], words[(words > 0) & (words < window)])]
        if n >= window:
            row = np.repeat(np.arange(len(seqs)), sizes + 1)[: n - window + 1]
            inside = np.flatnonzero(np.arange(n - window + 1) + window <= (starts + words)[row])
            kept.append(np.lib.stride_tricks.sliding_window_view(order, window)[inside].argmin(axis=1) + inside)
        least = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        least = least[good[least]]
    of = np.searchsorted(starts, least, "right") - 1
    return of, order[least].astype(np.int64), least - starts[of], (other < here)[least]


def minimizers_of(seq: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, turned) of one sequence."""
    return minimizers_of_all([seq], window)[1:]


def minimizers(rows: DataFrame, keys: list[str], seq: str = "seq", window: int = WINDOW) -> DataFrame:
    """(keys, word, at, turned) of the minimizers of each sequence; null and short ones have none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches):
        for batch in batches:
            seqs, at = [x or "" for x in batch.column(seq).to_pylist()], 0
            while at < len(seqs):
                stop, held = at, 0
                while stop < len(seqs) and (stop == at or held + len(seqs[stop]) < LETTERS):
                    held, stop = held + len(seqs[stop]) + 1, stop + 1
                of, word, place, turned = minimizers_of_all(seqs[at:stop], window)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of + at)) for k in keys), pa.array(word), pa.array(place), pa.array(turned)], [*keys, "word", "at", "turned"])
                at = stop

    return rows.select(*keys, seq).mapInArrow(run, f"{kinds}, word long, at long, turned boolean")


def genome_index(contigs: DataFrame, size: int = 1 << 16, window: int = WINDOW) -> DataFrame:
    """(word, chrom, at, turned): the minimizers of contigs(chrom, seq), each once; a table to be written once and read for each set of
    queries. A contig is dealt out in tiles with as much around them as decides whether a place is one. A match of window + WORD - 1 bases
    is always found; window 1 holds all words, for short queries and small libraries."""
    lead, tail = window - 1, window - 1 + WORD - 1
    size = max(size, tail)
    number, begin, parts = free(contigs, "tile", "begin", "parts")
    cut_ = contigs.where(F.length("seq") > 0).select("chrom", pieces_of(F.col("seq"), size).alias(parts))
    beside = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    around = F.transform(parts, lambda x, i: F.concat(F.right(beside(i - 1), F.lit(lead)), x, F.left(beside(i + 1), F.lit(tail))))
    laid = cut_.select("chrom", F.posexplode(around).alias(number, "seq")).withColumn(number, F.col(number).cast("long"))
    # Dealt out: the pieces of a contig come from one task.
    tasks = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = laid.withColumn(begin, F.greatest(F.col(number) * size - lead, F.lit(0))).repartition(tasks, "chrom", number)
    found = minimizers(pieces, ["chrom", number, begin], window=window).withColumn("at", F.col("at") + F.col(begin))
    return found.where((F.col("at") >= F.col(number) * size) & (F.col("at") < (F.col(number) + 1) * size)).select("word", "chrom", "at", "turned")


def seeds(queries: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(query_id, size, chrom, strand, ref, at): places of the genome where a query's minimizer stands; `at` is on the strand that fits.

    A word of at most COMMON places counts in all of them. A commoner one counts only among the RARE rarest of its query (of equal counts the
    lesser word), and then in all its places: no place is drawn or dropped, and a query that lies in a repeat
    altogether costs the places of its RARE rarest words."""
    sizes = queries.select("query_id", F.length("seq").cast("long").alias("size"), "seq")
    asked = minimizers(sizes, ["query_id", "size"], window=window)
    counts = index.groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    # Neither join is a broadcast: a genome's words are many more than the size of what they are derived from says.
    known = asked.join(counts.hint("merge"), "word")
    # A query's words are few; those of queries are ranked by them, not by places.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("places", "word", "at"))
    used = known.withColumn("rank", rank).where((F.col("places") <= COMMON) | (F.col("rank") <= RARE)).select("query_id", "size", "word", F.col("at").alias("q"), F.col("turned").alias("q_turned"))
    met = used.join(index.hint("merge"), "word")
    same = F.col("q_turned") == F.col("turned")
    return met.select("query_id", "size", "chrom", F.when(same, "+").otherwise("-").alias("strand"), F.col("at").alias("ref"), F.when(same, F.col("q")).otherwise(F.col("size") - WORD - F.col("q")).alias("at"))


def chained(hits: list[tuple[int, int]]) -> list[tuple]:
    """(score, q_start, q_end, r_start, r_end, least and greatest diagonal) of the chains of (ref, at), sorted: each hit is in one chain, and goes with
    the best of the BEFORE hits before it that lie at most GAP back in both; covered bases count, gaps cost."""
    best, back = [], []
    for i, (r, q) in enumerate(hits):
        top, via = float(WORD), -1
        for j in range(i - 1, max(-1, i - 1 - BEFORE), -1):
            dr, dq = r - hits[j][0], q - hits[j][1]
            if dr > GAP:
                break
            if dq <= 0 or dr <= 0 or dq > GAP:
                continue
            gain = best[j] + min(dr, dq, WORD) - (0.01 * WORD * abs(dr - dq) + (1.0 if dr != dq else 0.0))
            if gain > top:
                top, via = gain, j
        best.append(top)
        back.append(via)
    out, used = [], [False] * len(hits)
    for i in sorted(range(len(hits)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        members, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            members.append(hits[j])
            j = back[j]
        score = best[i] - (best[j] if j >= 0 else 0.0)
        shifts = [r - q for r, q in members]
        out.append((score, members[-1][1], members[0][1] + WORD, members[-1][0], members[0][0] + WORD, min(shifts), max(shifts)))
    return out


def chosen(chains: list[tuple], size: int) -> list[tuple]:
    """Of chains (score, chrom, strand, q_start, q_end, ...) those that share at most half of themselves, on the query's own strand, with a better one; each with
    the best score of those that it takes the place of (0 if none). Equal scores go by chrom, strand and place."""
    kept: list[list] = []
    for chain in sorted(chains, key=lambda c: (-c[0], *c[1:])):
        start, end = (chain[3], chain[4]) if chain[2] == "+" else (size - chain[4], size - chain[3])
        for other in kept:
            if 2 * (min(end, other[2]) - max(start, other[1])) > end - start:
                other[3] = max(other[3], chain[0])
                break
        else:
            kept.append([chain, start, end, 0.0])
    return [(*c, second) for c, _, _, second in kept]


CHAIN = "chain int, chain_score double, second double, chrom string, strand string, q_start long, q_end long, r_start long, r_end long, low long, high long"


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        c = table.column(name)
        unlike = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
        one_null = pc.xor(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1)))
        out[1:] |= pc.fill_null(unlike, False).to_numpy(zero_copy_only=False) | one_null.to_numpy(zero_copy_only=False)
    return out


def _chains_of(table: pa.Table, names: list[str]) -> pa.Table:
    """The chains of whole queries' hits (query_id, size, chrom, strand, ref, at), sorted. Hits on one diagonal are one chain, as each goes best with the one
    before it; where the best chain of a query leaves no other, none are compared. The rest goes through `chained` and `chosen`."""
    ref, at, size = (table.column(n).to_numpy() for n in ("ref", "at", "size"))
    new_query, new_group = _starts(table, ["query_id", "size"]), _starts(table, ["chrom", "strand"])
    first = np.flatnonzero(new_query | new_group | np.append(True, np.diff(ref) > GAP))
    last = np.append(first[1:], len(ref)) - 1
    step = np.append(0, np.diff(ref))
    step[first] = 0
    shift = ref - at
    low, high = np.minimum.reduceat(shift, first), np.maximum.reduceat(shift, first)
    inside = np.ones(len(ref), bool)
    inside[first] = False
    plain = (low == high) & (np.add.reduceat(inside & (step <= 0), first) == 0)
    score = WORD + np.add.reduceat(np.minimum(step, WORD), first).astype(float)
    plus = pc.equal(table.column("strand"), "+").to_numpy(zero_copy_only=False)[first]
    q_start, q_end = at[first], at[last] + WORD
    start, end = np.where(plus, q_start, size[first] - q_end), np.where(plus, q_end, size[first] - q_start)
    # Stretches by query: the best, if it is alone in its score, and whether it takes the place of all others.
    query = np.flatnonzero(new_query[first])
    of = np.repeat(np.arange(len(query)), np.diff(np.append(query, len(first))))
    top = np.maximum.reduceat(score, query)
    is_top = score == top[of]
    best = np.flatnonzero(is_top)[np.searchsorted(of[is_top], np.arange(len(query)))]
    hidden = 2 * (np.minimum(end, end[best][of]) - np.maximum(start, start[best][of])) > end - start
    simple = np.logical_and.reduceat(plain & (is_top | hidden), query) & (np.add.reduceat(is_top.astype(int), query) == 1)
    second = np.maximum.reduceat(np.where(is_top, 0.0, score), query)
    b = best[simple]
    rows = pa.array(first[b])
    taken = lambda n: table.column(n).take(rows).combine_chunks()
    quick = [taken("query_id"), taken("size"), pa.array(np.zeros(len(b), np.int32)), pa.array(score[b]), pa.array(second[simple]), taken("chrom"), taken("strand"), *(pa.array(x) for x in (q_start[b], q_end[b], ref[first[b]], ref[last[b]] + WORD, low[b], high[b]))]
    done = [pa.Table.from_arrays(quick, names)]
    slow: list[tuple] = []
    for k in np.flatnonzero(~simple).tolist():
        held, begin = [], query[k]
        for i in range(begin, query[k + 1] if k + 1 < len(query) else len(first)):
            chrom, strand = table.column("chrom")[first[i]].as_py(), table.column("strand")[first[i]].as_py()
            if plain[i]:
                held.append((score[i], chrom, strand, *(int(x[i]) for x in (q_start, q_end)), int(ref[first[i]]), int(ref[last[i]]) + WORD, int(low[i]), int(high[i])))
            else:
                held += [(c[0], chrom, strand, *c[1:]) for c in chained(list(zip(ref[first[i] : last[i] + 1].tolist(), at[first[i] : last[i] + 1].tolist())))]
        own = int(first[begin])
        slow += [(own, n, c[0], c[-1], *c[1:-1]) for n, c in enumerate(chosen(held, int(size[own])))]
    if slow:
        columns = list(zip(*slow))
        rows = pa.array(columns[0], pa.int64())
        kinds = [pa.int32(), pa.float64(), pa.float64(), done[0].schema.field("chrom").type, done[0].schema.field("strand").type, *[pa.int64()] * 6]
        done.append(pa.Table.from_arrays([taken_at.take(rows).combine_chunks() for taken_at in (table.column("query_id"), table.column("size"))] + [pa.array(c, k) for c, k in zip(columns[1:], kinds)], names))
    return pa.concat_tables(done)


def chains(found: DataFrame) -> DataFrame:
    """(query_id, size, CHAIN) of seeds: the chains of each query, the best one first (0)."""
    kind = dict(found.dtypes)["query_id"]
    names = ["query_id", "size", *(f.split()[0] for f in CHAIN.split(", "))]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Whole queries are looked at; the last one may go on in the next batch.
            known = pa.Table.from_batches([*([held[-1].slice(held[-1].num_rows - 1)] if held else []), batch])
            begins = np.flatnonzero(_starts(known, ["query_id", "size"])[1 if held else 0 :])
            cut_at = int(begins[-1]) if len(begins) else 0
            if len(begins) and (held or cut_at):
                yield from _chains_of(pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks(), names).to_batches()
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield from _chains_of(pa.Table.from_batches(held).combine_chunks(), names).to_batches()

    order = ["query_id", "size", "chrom", "strand", "ref", "at"]
    # A fixed number of tasks: chains cost far more than their bytes.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select(*order).repartition(tasks, "query_id").sortWithinPartitions(*order).mapInArrow(run, f"query_id {kind}, size long, {CHAIN}")


def banded(query: str, target: str, low: int, high: int) -> tuple | None:
    """(score, t_start, q_start, q_end, cigar, edits) of the best local alignment with affine gaps within diagonals low to high (target less query);
    None if no base meets. Of equal scores that which ends first in the query, then in the target. Two rows of scores are held, and a byte for
    each cell of the band."""
    x, y = (np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8) for s in (query, target))
    m, wide = len(x), high - low + 1
    if not m or not len(y) or wide <= 0:
        return None
    known = np.frombuffer(b"ACGT", np.uint8)
    flank = np.zeros(max(0, -low) + wide, np.uint8)
    laid = np.concatenate([flank, np.where(np.isin(y, known), y, 1), np.full(m + wide + max(0, high), 0, np.uint8)])
    shift = len(flank) + low
    far = -(1 << 20)
    held, down = np.zeros(wide, np.int32), np.full(wide, far, np.int32)
    ways = np.zeros((m, wide), np.uint8)
    slope = EXTEND * np.arange(wide, dtype=np.int32)
    best = (0, -1, -1)
    for i in range(m):
        letters = laid[shift + i : shift + i + wide]
        inside = letters != 0
        # A step down takes a base of the query only: the cell above and to the right.
        opened = np.append(held[1:], far) - OPEN - EXTEND
        longer = np.append(down[1:], far) - EXTEND
        down = np.maximum(opened, longer)
        straight = held + np.where(letters == x[i], MATCH, MISMATCH)
        first = np.where(inside, np.maximum(np.maximum(straight, down), 0), 0)
        begun = np.append(far, first[:-1] - OPEN - EXTEND)
        along = np.append(far, np.maximum.accumulate(first + slope)[:-1] - OPEN - EXTEND - slope[:-1])
        now = np.where(inside, np.maximum(first, along), 0)
        # 1: straight, 2: down, 3: along, 0: begins here; 4: the step down goes on, 8: that along does.
        ways[i] = np.where(now <= 0, 0, np.where(now == straight, 1, np.where(now == down, 2, 3))) | np.where(longer > opened, 4, 0) | np.where(along > begun, 8, 0)
        held, down = now.astype(np.int32), np.where(inside, down, far).astype(np.int32)
        k = int(held.argmax())
        if held[k] > best[0]:
            best = (int(held[k]), i, k)
    score, i, k = best
    if i < 0:
        return None
    ops: list[str] = []
    q_end, edits = i + 1, 0
    while i >= 0 and (way := int(ways[i, k]) & 3):
        if way == 1:
            edits += int(laid[shift + i + k] != x[i])
            ops.append("M")
            i -= 1
        elif way == 2:
            going = True
            while going:
                going = bool(ways[i, k] & 4)
                ops.append("I")
                edits += 1
                i, k = i - 1, k + 1
        else:
            going = True
            while going:
                going = bool(ways[i, k] & 8)
                ops.append("D")
                edits += 1
                k -= 1
    return score, low + i + 1 + k, i + 1, q_end, "".join(f"{len(list(g))}{op}" for op, g in groupby(reversed(ops))), edits


def best_scores(pairs: list[tuple[str, str, int]], size: int, wide: int) -> np.ndarray:
    """The scores that `banded` finds for (query, target, low), of queries of `size` letters and bands of `wide` diagonals, whose tables are filled side by side; 0 if no base meets."""
    n = len(pairs)
    x = np.frombuffer("".join(q.upper() for q, _, _ in pairs).encode("ascii", "replace"), np.uint8).reshape(n, size)
    known = np.ones(256, np.uint8)
    known[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"ACGT", np.uint8)
    laid = np.zeros((n, size + wide - 1), np.uint8)
    for j, (_, target, low) in enumerate(pairs):
        a, z = max(low, 0), min(low + size + wide - 1, len(target))
        if z > a:
            laid[j, a - low : z - low] = known[np.frombuffer(target[a:z].upper().encode("ascii", "replace"), np.uint8)]
    far = -(1 << 20)
    held, down, top = np.zeros((n, wide), np.int32), np.full((n, wide), far, np.int32), np.zeros(n, np.int32)
    opened, longer, along = (np.full((n, wide), far, np.int32) for _ in range(3))
    slope = EXTEND * np.arange(wide, dtype=np.int32)
    for i in range(size):
        letters = laid[:, i : i + wide]
        inside = letters != 0
        opened[:, :-1], longer[:, :-1] = held[:, 1:] - (OPEN + EXTEND), down[:, 1:] - EXTEND
        down = np.maximum(opened, longer)
        first = np.where(inside, np.maximum(np.maximum(held + np.where(letters == x[:, i : i + 1], MATCH, MISMATCH).astype(np.int32), down), 0), 0)
        along[:, 1:] = np.maximum.accumulate(first + slope, axis=1)[:, :-1] - (OPEN + EXTEND) - slope[:-1]
        held, down = np.where(inside, np.maximum(first, along), 0), np.where(inside, down, far)
        top = np.maximum(top, held.max(axis=1))
    return top


def on_one_diagonal(query: str, target: str, low: int) -> tuple | None:
    """banded without its table, where one diagonal is best anyway: a gap costs OPEN + EXTEND at least, so no alignment with one beats
    an ungapped one that loses no more than that. None if it may not be best."""
    if 0 <= low and low + len(query) <= len(target):
        x, y = (np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8) for s in (query, target[low : low + len(query)]))
        same = (x == y) & (_CODE[x] < 4)
        sums = np.append(0, np.cumsum(np.where(same, MATCH, MISMATCH)))
        gain = sums - np.minimum.accumulate(sums)
        end = int(gain.argmax())
        if gain[end] >= len(query) * MATCH - OPEN - EXTEND:
            start = int(end - np.argmin(sums[: end + 1][::-1]))  # the last least sum begins it, as a table's 0 does
            return int(gain[end]), low + start, start, end, f"{end - start}M", int((~same[start:end]).sum())
    return None


def placed(query: str, target: str, low: int, high: int) -> tuple | None:
    """banded with BAND beside the diagonals low to high, without its table where it isn't needed."""
    return (on_one_diagonal(query, target, low) if low == high else None) or banded(query, target, low - BAND, high + BAND)


def all_placed(queries: list[tuple[str, str, int, int]], least: int) -> list[tuple | None]:
    """placed of each (query, target, low, high) that scores `least` or more, else None. Most chains that chance has made score less, which
    is found out for CELLS cells of tables at once; only the others' tables are kept and walked back."""
    out: list[tuple | None] = [on_one_diagonal(q, t, low) if low == high else None for q, t, low, high in queries]
    left: dict[tuple[int, int], list[int]] = {}
    for i, (q, _, low, high) in enumerate(queries):
        if out[i] is None and q:
            left.setdefault((len(q), high - low + 1 + 2 * BAND), []).append(i)
    for (size, wide), rows in left.items():
        together = max(1, CELLS // wide)
        for k in range(0, len(rows), together):
            part = rows[k : k + together]
            scores = best_scores([(queries[i][0], queries[i][1], queries[i][2] - BAND) for i in part], size, wide)
            for i in (i for i, score in zip(part, scores) if score >= max(least, 1)):
                q, t, low, high = queries[i]
                out[i] = banded(q, t, low - BAND, high + BAND)
    return [hit if hit is not None and hit[0] >= least else None for hit in out]


MAPPING = "chrom string, pos long, strand string, cigar string, score long, nm long, mapq int, q_start long, q_end long, part int"


def aligned(queries: DataFrame, contigs: DataFrame, index: DataFrame | None = None, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(query_id, MAPPING) of queries(query_id, seq) on contigs(chrom, seq), whose names are unique: one row for each stretch of a query
    that stands somewhere, as a split query has several (`part` 0 is the best chain's). pos is 0-based; cigar and q_start, q_end are on
    the strand that fits, and what they leave out is soft-clipped. mapq is 60 less 60 times the second best chain's share
    of the best one's score, 0 if they are equal: such a query stands in several places, of which the first by name and place is given.

    Alignments score MATCH, MISMATCH, OPEN + EXTEND for a gap's first base and EXTEND for others, within BAND of the chain's diagonals; those below `least`
    go. Queries that are null, shorter than a word or of low complexity have no rows; ids of queries are unique. index: genome_index(contigs), if it
    was written before, with the same window.
    """
    asked = queries.select("query_id", F.upper("seq").alias("seq"))
    # Index and chains are written, as both are read twice: for counts and places, for the genome's pieces and what is aligned to them.
    found = written(chains(seeds(asked, written(genome_index(contigs, window=window)) if index is None else index, window)))
    begin = F.greatest(F.col("r_start") - F.col("q_start") - PAD - BAND, F.lit(0))
    spans = found.select("query_id", "chain", "chrom", begin.alias("start"), (F.col("r_end") + F.col("size") - F.col("q_end") + PAD + BAND).alias("end"))
    pieces = fetch(spans, tiles(contigs.select("chrom", F.upper("seq").alias("seq")), TILE), ["query_id", "chain"], TILE, "target")
    met = found.withColumn("begin", begin).join(pieces, ["query_id", "chain"]).join(asked, "query_id")
    turned = met.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    kind = dict(queries.dtypes)["query_id"]
    names = ["query_id", *(f.split()[0] for f in MAPPING.split(", "))]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            rows = []
            each = list(zip(*(c.to_pylist() for c in batch.columns)))
            hits = all_placed([(seq, target, low - begin, high - begin) for _, seq, target, begin, low, high, *_ in each], least)
            for (query, seq, _, begin, _, _, chrom, strand, score, second, part), hit in zip(each, hits):
                if hit is None:
                    continue
                clip = lambda n: f"{n}S" if n else ""
                rows.append((query, chrom, begin + hit[1], strand, clip(hit[2]) + hit[4] + clip(len(seq) - hit[3]), hit[0], hit[5], max(0, round(60 - 60 * second / score)), hit[2], hit[3], part))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns[1:], MAPPING.split(", ")))], names)

    return turned.select("query_id", "seq", "target", "begin", "low", "high", "chrom", "strand", "chain_score", "second", "chain").mapInArrow(run, f"query_id {kind}, {MAPPING}")


def realigned_counts(spans: DataFrame, clipped: DataFrame, library: DataFrame, least_clip: int = 15, most_other: int = 2) -> DataFrame:
    """(span_id, n): of reads clipped by least_clip bases or more, and by at most most_other on the minor side, those that overlap a span and whose clipped part aligns to the
    library, or doesn't but begins with ten A. spans(span_id, chrom, start, end), clipped: `reads.with_alignment`, library(chrom, seq) of elements.
    Spans without such reads, or with an end not behind their start, have 0; ids of spans are unique. A library is of elements, so all its words are looked at."""
    ours = clipped.where((F.col("rlen") - F.col("alen") >= least_clip) & (F.col("alen") > 0) & (F.least(F.col("qstart"), F.col("rlen") - F.col("qend")) <= most_other))
    reads = ours.select("chrom", F.col("pos").alias("start"), F.col("ref_end").alias("end"), clipped_part(F.upper("seq")).alias("part"))
    parts = reads.select("part").distinct().select(F.col("part").alias("query_id"), F.col("part").alias("seq"))
    hits = aligned(parts, library, least=least_clip, window=1).select(F.col("query_id").alias("part")).distinct().withColumn("aligns", F.lit(True))
    told = reads.join(hits, "part", "left").where(F.coalesce("aligns", F.lit(False)) | F.startswith("part", F.lit("A" * 10)))
    # Reads that begin before a span's end, less those that end before it: spans look both numbers up, and meet no read.
    lying = told.where("chrom is not null and end >= start")
    step = F.explode(F.array(F.struct((F.col("start") + 1).cast("long").alias("at"), F.lit(1).alias("begun"), F.lit(0).alias("ended")), F.struct(F.col("end").cast("long").alias("at"), F.lit(0).alias("begun"), F.lit(1).alias("ended"))))
    steps = lying.select("chrom", step.alias("e")).select("chrom", "e.*").groupBy("chrom", "at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    wanted = spans.where("start < end").select("span_id", "chrom", F.explode(F.array(F.struct(F.col("end").cast("long").alias("at"), F.lit(True).alias("last")), F.struct(F.col("start").cast("long").alias("at"), F.lit(False).alias("last")))).alias("e")).select("span_id", "chrom", "e.*")
    marks = wanted.select("chrom", "at").distinct().select("chrom", "at", *[F.lit(0).cast("long").alias(n) for n in ("begun", "ended")])
    total = running(steps.unionByName(marks), ["chrom"], "at", ["begun", "ended"])
    met = wanted.hint("merge").join(total, ["chrom", "at"]).groupBy("span_id").agg(F.sum(F.when(F.col("last"), F.col("begun")).otherwise(-F.col("ended"))).alias("n"))
    return spans.select("span_id").join(met, "span_id", "left").select("span_id", F.coalesce("n", F.lit(0)).alias("n"))
