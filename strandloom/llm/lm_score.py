"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end, the tokens of the base score, so blanks and A-Z cost nothing in either. Each
token is coded in binary by a code of the training corpus; a word that isn't in the code's vocabulary (tokens seen at
least twice) is an escape and then its bytes and a stop, in a code of bytes. For each bit, four predictors look up a slot
of (context, code node): for words the node alone, the last frequent word before, the word before, and the two words
before; for bytes the two bytes before, three bytes with the last frequent word, four bytes, and the word so far. A slot
holds the log-odds of the bits that training texts had there. A gate chosen by the bit's place in its code, and by how
sure two of the predictors are, picks the weights that mix the log-odds. They start from fixed weights, the same for any
corpus, and go on learning within each text, every BLOCK symbols; each text begins anew. So all that is learned of the
corpus are counts, and all training rows are in them. The sum of log-probabilities is the text's; over its bytes it
gives bits per byte.

The corpus is read whole three times: for counts of tokens and bytes, for the bit counts, and to score. Token counts
meet by a shuffle, summed before it. Bit counts are tables whose size follows the training tokens up to 2**MOST_BITS
slots a predictor, summed as slices that stream through sorted partitions. Tokens that occur often enough for at most
MAX_VOCAB of them are broadcast, which is measured first, and are the code's words; the rest, none of which is frequent,
are spelled, and met by a join for the base score.

Tokens are known by a 64-bit hash. Decisions are looked up SEGMENT at a time, so memory follows a chunk's text or the
longest text. Defined cases: a null text is empty and has one token, the end; a null doc_id counts as empty text for
holding out; repeated rows each get a row, ties in counts are cut at the count; without training rows every count is 0
and the log-odds are 0; only doc_id and the text are read, so other columns' names don't matter; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, table
from .textbytes import LOWER, NON_BLANK, _power, mix64, prefix_hash, span_hash, text_chunks, word_spans

#: Log2 of the hashed slots of a predictor: for words by the training tokens, within these bounds, and for bytes.
LEAST_BITS, MOST_BITS, BYTE_BITS = 16, 22, (18, 20, 20, 21)
END, ESCAPE, STOP = 0, 1, 256
#: Code length up to which a word counts as frequent.
OFTEN = 6
PLACES, BYTE_PLACES = 18, 6
GATES = 9 * (PLACES + BYTE_PLACES)
#: Starting weights of the predictors, of words and of bytes.
START = (0.3, 0.8, 0.45, 0.3), (0.35, 0.55, 0.3, 0.25)
#: Symbols after which the weights of a text learn, and how fast.
BLOCK, RATE = 32, 0.03
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000
#: Texts and bytes that are scored side by side.
GROUP_ROWS, GROUP_BYTES = 250, 1 << 19
MAX_VOCAB = 6_000_000
SLICE, CHUNK, SEGMENT = 1 << 11, 1 << 19, 1 << 13
END_TOKEN = -1
PRIOR, SCALE = 0.3, 14
#: Odd factors of the slots' hash: of context and node, and of the node before.
SPREAD, MARK = 0x85EBCA6B, 0x9E3779B1
#: Log-odds from which a slot is somewhat sure, and very sure.
LEVELS = (0.7, 2.5)
_U32, _U64 = np.uint32, np.uint64


class Code:
    """Canonical codes of words (END, ESCAPE, then the vocabulary) and of bytes (and STOP), whose symbols follow.

    A symbol of share p has about -log2(p) bits; short ones come first, so at each depth the nodes that
    go on are a run of numbers, and every node of both codes gets a number of its own.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, seen: np.ndarray):
        """hashes, counts: known tokens, by hash; tokens: how many there are of all; seen: counts of bytes, then of ends."""
        words = (counts >= 2) & (hashes != END_TOKEN)
        vocabulary = counts[words].astype(np.int64)
        left = max(0, tokens - int(seen[256]) - int(vocabulary.sum()))
        self.symbol = np.full(len(hashes), ESCAPE, np.int32)
        self.symbol[words] = np.arange(2, 2 + len(vocabulary), dtype=np.int32)
        self.words = 2 + len(vocabulary)
        self.bits = int(np.clip(math.ceil(math.log2(max(tokens, 1))) + 1, LEAST_BITS, MOST_BITS))
        parts, self.nodes, offsets = [], 0, []
        for c in (np.concatenate([[seen[256] + 1, left + 1], vocabulary]), np.append(seen[:256], left) + 1):
            share = np.maximum(c / c.sum(), 2.0**-29)
            share /= share.sum()
            length = np.clip(np.ceil(-np.log2(share)), 1, 30).astype(np.int64)
            # Rounding up leaves room in the tree, which goes to those symbols that lost most by it.
            gain = np.argsort(-share * 2.0**length, kind="stable")
            gain = gain[length[gain] > 1]
            length[gain[np.cumsum(2.0 ** -length[gain]) <= 1 - np.sum(2.0**-length)]] -= 1
            order = np.argsort(length, kind="stable")
            length = length[order]
            deep = int(length.max())
            ends = np.cumsum(np.int64(1) << (deep - length))
            path = (ends - (np.int64(1) << (deep - length))) >> (deep - length)
            at = []
            for d in range(deep):
                k = int(np.searchsorted(length, d, "right"))
                first, last = (int(ends[k - 1]) >> (deep - d) if k else 0), int(ends[-1] - 1) >> (deep - d)
                at.append(self.nodes - first)
                self.nodes += last - first + 1
            offsets.append(at)
            back = np.argsort(order)
            parts.append((length[back].astype(np.uint8), path[back]))
        self.length, self.path = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(_U32)
        self.deep = max(len(at) for at in offsets)
        self.counts = narrow(np.concatenate([[seen[256] + 1, left + 1], vocabulary]))
        self.offset = np.array([at + [0] * (self.deep - len(at)) for at in offsets], np.int64).astype(_U32).ravel()  # modulo 2**32, as all sums with it

    def node_counts(self) -> np.ndarray:
        """counts[node, bit], flattened, of the words, as the corpus has them."""
        out = np.zeros(2 * self.zone(0), np.int64)
        length, path = self.length[: self.words].astype(_U32), self.path[: self.words]
        for d in range(int(length.max())):
            deeper = np.flatnonzero(length > d)
            rest = path[deeper] >> (length[deeper] - _U32(d + 1))
            np.add.at(out, 2 * ((rest >> _U32(1)) + self.offset[d]).astype(np.int64) + (rest & _U32(1)), self.counts[deeper])
        return out

    def zone(self, k: int) -> int:
        """Slots of words in the table of predictor k; those of bytes follow."""
        return 1 << self.bits if k else (self.nodes + SLICE - 1) // SLICE * SLICE

    def sizes(self) -> list[int]:
        return [self.zone(k) + (1 << b) for k, b in enumerate(BYTE_BITS)]


class Decisions:
    """The binary decisions of symbols in a given order: the bit, the place in its code, and the slot of each predictor.

    What is the same for all bits of a symbol is worked out once for the symbol and repeated; `ends` says where each symbol's bits end."""

    def __init__(self, s: Symbols, order: np.ndarray, code: Code):
        symbol, spelled = s.symbol[order], s.spelled[order]
        length = code.length[symbol]
        self.ends = np.cumsum(length, dtype=np.int64)
        depth = np.arange(self.ends[-1] if len(order) else 0, dtype=_U32) - np.repeat((self.ends - length).astype(_U32), length)
        spelled = np.repeat(spelled, length).astype(_U32)
        # The code's bits from the highest down; what is left of the bit after `depth` of them is the way so far.
        rest = np.repeat(code.path[symbol] << (_U32(32) - length), length) >> (_U32(31) - depth)
        self.bit = (rest & _U32(1)).astype(np.uint8)
        self.place = (depth + spelled * _U32(code.deep)).astype(np.intp)
        self.node = (rest >> _U32(1)) + code.offset.take(self.place)
        self.mask = _U32(0) - spelled
        self.mark = self.node * _U32(SPREAD * MARK & 0xFFFFFFFF)
        self.s, self.order, self.length, self.code = s, order, length, code

    def slots(self, k: int) -> np.ndarray:
        """Words in a table's first zone, bytes behind it; a word's slot of the first predictor is the node's own."""
        h = np.repeat(self.s.hashed[k][self.order] * _U32(SPREAD), self.length)
        h += self.mark
        h >>= _U32(7)
        if not k:
            return np.where(self.mask != 0, (h & _U32((1 << BYTE_BITS[0]) - 1)) + _U32(self.code.zone(0)), self.node)
        words, spelled = (1 << self.code.bits) - 1, (1 << BYTE_BITS[k]) - 1
        h &= (self.mask & _U32(words ^ spelled)) ^ _U32(words)
        h += self.mask & _U32(self.code.zone(k))
        return h


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in four bytes each, if they all fit."""
    return counts.astype(_U32 if counts.max(initial=0) < 2**32 else np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> _U64(32)).astype(_U32)


def find(have: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the hashes h are in the sorted `have`; -1 where they are absent."""
    if not len(have):
        return np.full(len(h), -1)
    uniq, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(have, uniq), len(have) - 1)
    return np.where(have[at] == uniq, at, -1)[back]


class Symbols:
    """The symbols of a chunk of texts in order, with row, place in the row and contexts; and its tokens' hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, have: np.ndarray, code: Code):
        data, rows = LOWER[data], len(offsets) - 1
        starts, ends, of, _ = word_spans(data, offsets, NON_BLANK)
        prefix = prefix_hash(data)
        h = span_hash(prefix, starts, ends)
        self.token, self.token_row = h.view(np.int64), of
        # Tokens with each row's end put in.
        many = np.bincount(of, minlength=rows)
        here, stop = np.arange(len(h)) + of, np.cumsum(many) + np.arange(rows)
        n = len(h) + rows
        row, symbol = np.zeros(n, np.int32), np.full(n, END, np.int32)
        row[here], row[stop] = of, np.arange(rows)
        self.found = find(have, self.token)
        symbol[here] = ESCAPE
        symbol[here[self.found >= 0]] = code.symbol[self.found[self.found >= 0]]
        before = [np.zeros(n, _U64) for _ in range(3)]
        for k in (1, 2):
            before[k][k:] = np.where(row[k:] == row[:-k], symbol[:-k].astype(_U64) + _U64(1), _U64(0))
        # The last frequent word before, which tells languages and kinds of text apart.
        often = np.where((code.length[symbol] <= OFTEN) & (symbol > ESCAPE), np.arange(n), -1)
        last = np.full(n, -1)
        last[1:] = np.maximum.accumulate(often)[:-1]
        before[0][:] = np.where((last >= 0) & (row[last] == row), symbol[last].astype(_U64) + _U64(1), _U64(0))
        size = np.ones(n, np.int64)
        rare = np.flatnonzero(symbol[here] == ESCAPE)
        length = ends[rare] - starts[rare]
        size[here[rare]] += length + 1
        first = np.cumsum(size) - size
        total = int(size.sum())
        self.row = np.repeat(row, size)
        self.symbol = np.zeros(total, np.int32)
        self.symbol[first] = symbol
        self.hashed = [np.zeros(total, _U32) for _ in BYTE_BITS]
        self.hashed[1][first] = _short(before[0] + _U64(1 << 50))
        self.hashed[2][first] = _short(before[1] + _U64(1 << 51))
        self.hashed[3][first] = _short(before[1] * _U64(0x9E3779B97F4A7C15) + before[2])
        # The bytes of words out of the vocabulary, and the stop after each.
        which = np.repeat(np.arange(len(rare)), length + 1)
        j = np.arange(len(which)) - (np.cumsum(length + 1) - length - 1)[which]
        at, begin = starts[rare][which] + j, starts[rare][which]
        out = first[here[rare]][which] + 1 + j
        byte = np.append(data, np.uint8(0))[at].astype(np.int32)
        byte[j == length[which]] = STOP
        self.symbol[out] = byte + code.words
        recent, gone = np.zeros(len(at), _U64), np.minimum(j, 7).astype(_U64) << _U64(40)
        for k in range(1, 5):
            recent |= np.where(j >= k, data[np.maximum(at - k, 0)] if len(data) else 0, 0).astype(_U64) << _U64(8 * k - 8)
            if k == 2:
                self.hashed[0][out] = _short(recent + _U64(1 << 41))
            if k == 3:
                self.hashed[1][out] = _short(recent * _U64(0x9E3779B97F4A7C15) + before[0][here[rare]][which])
            if k == 4:
                self.hashed[2][out] = _short(recent + _U64(1 << 42))
        self.hashed[3][out] = _short((prefix[at] - prefix[begin]) * _power("down", len(prefix))[begin] + _U64(1))
        start = np.searchsorted(self.row, np.arange(rows))
        self.place = np.arange(total) - start[self.row]
        self.spelled = (self.symbol >= code.words).astype(np.uint8)


def count_bits(data: np.ndarray, offsets: np.ndarray, have: np.ndarray, code: Code, into: list[np.ndarray], times: int = 1) -> None:
    """Adds the bits, `times` over, to counts[slot, bit], flattened, of each predictor; those of the words' own nodes follow from the code."""
    s = Symbols(data, offsets, have, code)
    for a in range(0, len(s.symbol), SEGMENT):
        d = Decisions(s, np.arange(a, min(a + SEGMENT, len(s.symbol))), code)
        for k, counts in enumerate(into):
            at = ((d.slots(k) << _U32(1)) | d.bit).astype(np.intp)
            np.add.at(counts, at if k else at[d.mask != 0], counts.dtype.type(times))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of bit 1 over bit 0 in each slot, smoothed, in steps of 1 / SCALE; 0 where nothing was seen."""
    pair = counts.reshape(-1, 2).astype(np.float32) + np.float32(PRIOR)
    return np.rint(np.clip(np.log(pair[:, 1] / pair[:, 0]) * SCALE, -127, 127)).astype(np.int8)


def level(steps: np.ndarray) -> np.ndarray:
    """Of each value of a slot: 0 little or unseen, 1 somewhat sure, 2 very sure."""
    size = np.abs(steps)
    return (size > LEVELS[0] * SCALE).view(np.uint8) + (size > LEVELS[1] * SCALE).view(np.uint8)


class Mixer:
    """The tables, and the weights for each gate with which texts start."""

    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        self.weights = np.repeat(np.array(START, np.float32).T, [9 * PLACES, 9 * BYTE_PLACES], axis=1)
        depth = np.arange(code.deep)
        self.kinds = 9 * np.append(np.minimum(depth, PLACES - 1), PLACES + np.minimum(depth, BYTE_PLACES - 1))

    def look_up(self, d: Decisions) -> tuple[list[np.ndarray], np.ndarray]:
        """(log-odds of each predictor, gate) of all decisions."""
        steps = [t.take(d.slots(k)) for k, t in enumerate(self.tables)]
        return steps, self.kinds.take(d.place) + (level(steps[2]) * np.uint8(3) + level(steps[3]))

    def run(self, s: Symbols, rows: int) -> np.ndarray:
        """Natural log of each row's probability."""
        code = self.code
        # Longer rows first, so that those which go on are a leading part; each has weights of its own.
        size = np.bincount(s.row, minlength=rows)
        rank = np.empty(rows, np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(rows)
        block = (s.place // BLOCK).astype(np.int32)
        order = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
        weights = [np.tile(w, rows) for w in self.weights]
        total = np.zeros(rows)
        first = 0
        while first < len(edge) - 1:
            # As many whole blocks as fit into a segment, one at least.
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + SEGMENT, "right")) - 1)
            held = order[edge[first] : edge[last]]
            d = Decisions(s, held, code)
            steps, gate = self.look_up(d)
            odds = [x * np.float32(1 / SCALE) for x in steps]
            row = rank[s.row[held]]
            cell = np.repeat(row * GATES, d.length) + gate
            bit = d.bit.astype(np.float32)
            # Rows stand together in a block: where each begins, by symbols and by bits.
            inner = edge[first : last + 1] - edge[first]
            begins = np.append(True, row[1:] != row[:-1])
            begins[inner[:-1]] = True
            begins = np.flatnonzero(begins)
            at = np.append(0, d.ends)
            starts, ends, parts = at[begins], at[inner], np.searchsorted(begins, inner)
            del d, steps, gate
            for a, b, i, j in zip(ends[:-1], ends[1:], parts[:-1], parts[1:]):
                total[row[begins[i:j]]] += self._block(bit[a:b], [x[a:b] for x in odds], cell[a:b], weights, starts[i:j] - a)
            first = last
        return total[rank]

    @staticmethod
    def _block(bit, odds, cell, weights, begin) -> np.ndarray:
        """One block's log-probabilities, summed by row; only then do weights learn, as its bits must not tell of one another."""
        dot = odds[0] * weights[0].take(cell)
        for w, x in zip(weights[1:], odds[1:]):
            dot += x * w.take(cell)
        np.clip(dot, -12, 12, out=dot)
        p = 1 / (1 + np.exp(-dot))
        miss = bit - p
        found = np.add.reduceat(np.log(np.abs(bit - 1 + p)), begin, dtype=np.float64)
        miss *= np.float32(RATE)
        top = (int(cell.max()) // GATES + 1) * GATES
        for w, x in zip(weights, odds):
            np.add.at(w, cell, miss * x)
            np.clip(w[:top], -0.5, 2, out=w[:top])
        return found


def row_groups(column: pa.Array, most: int = GROUP_ROWS, max_bytes: int = GROUP_BYTES):
    """(bytes, offsets) of chunks of at most `most` texts each: every row has weights of its own."""
    for _, data, offsets in text_chunks(column, max_bytes):
        for a in range(0, len(offsets) - 1, most):
            part = offsets[a : a + most + 1]
            yield data[part[0] : part[-1]], part - part[0]


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, lower-cased."""
    data = LOWER[data]
    starts, ends, row, _ = word_spans(data, offsets, NON_BLANK)
    return span_hash(prefix_hash(data), starts, ends).view(np.int64), row


def corpus_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(kind, h, c): kind 0 a token's hash (END_TOKEN: the end), kind 1 a byte (256: the end)."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), 2 << 20):
                h, c = np.unique(np.append(token_spans(data, offsets)[0], np.full(len(offsets) - 1, END_TOKEN)), return_counts=True)
                b = np.append(np.bincount(LOWER[data], minlength=256), len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(h), 257]).astype(np.int32)), pa.array(np.append(h, np.arange(257))), pa.array(np.append(c, b))], ["kind", "h", "c"])

    return cut(train.select(text).mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")))


CODEC, SLICES = "zstd", "t int, i int, wide int, blob binary"


def _slices(counts: list[np.ndarray]):
    """Batches of SLICES: those slices of the counts in which something is, with the bytes of a count."""
    rows = [(t, i // SLICE, c.itemsize, pa.compress(part.tobytes(), CODEC, asbytes=True)) for t, c in enumerate(counts) for i in range(0, len(c), SLICE) if (part := c[i : i + SLICE]).any()]
    for a in range(0, len(rows), 512):
        t, i, wide, blob = zip(*rows[a : a + 512])
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(i, pa.int32()), pa.array(wide, pa.int32()), pa.array(blob, pa.binary())], ["t", "i", "wide", "blob"])


def _summed(slices: DataFrame, finish) -> DataFrame:
    """One row of SLICES for each (t, i), whose blob is finish(sums): sums stream by in sorted partitions."""

    def total(batches):
        key, held = None, np.zeros(SLICE, _U64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([8], pa.int32()), pa.array([finish(held)], pa.binary())], ["t", "i", "wide", "blob"])

        for batch in batches:
            for t, i, wide, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if (t, i) != key:
                    if key:
                        yield row()
                    key, held = (t, i), np.zeros(SLICE, _U64)
                held += np.frombuffer(pa.decompress(blob.as_py(), wide * SLICE, CODEC, asbytes=True), _U32 if wide == 4 else _U64)
        if key:
            yield row()

    return slices.repartition("t", "i").sortWithinPartitions("t", "i").mapInArrow(total, SLICES)


def bit_counts(train: DataFrame, shared, text: str = "text") -> DataFrame:
    """SLICES of the bit counts of all rows, one set for each task. shared: broadcast (have, code)."""

    def count(batches):
        have, code = shared.value
        counts = [np.zeros(2 * size, _U32) for size in code.sizes()]
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), CHUNK):
                count_bits(data, offsets, have, code, counts)
        yield from _slices(counts)

    return train.select(text).mapInArrow(count, SLICES)


def bit_tables(slices: DataFrame, code: Code) -> list[np.ndarray]:
    """Log-odds of all slots, from the sums of bit_counts."""
    tables = [np.zeros(size, np.int8) for size in code.sizes()]
    for r in _summed(slices, lambda c: pa.compress(log_odds(c).tobytes(), CODEC, asbytes=True)).collect():  # all slices together are a table of fixed size
        at = r.i * SLICE // 2
        tables[r.t][at : at + SLICE // 2] = np.frombuffer(pa.decompress(r.blob, SLICE // 2, CODEC, asbytes=True), np.int8)
    tables[0][: code.zone(0)] = log_odds(code.node_counts())
    return tables


def mixing_sample(train: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[tuple[str, int]], DataFrame]:
    """Texts to try settings on, with how many rows have each, and the rows without them or their copies. No score uses it.

    Of the whole texts of at most SAMPLE_CHARS in an eighth of all (by hash), the `rows` distinct ones of the lowest hash.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(content)
    eligible = (F.length(content) <= SAMPLE_CHARS) & (F.pmod(mark, F.lit(8)) == 0)
    marks = [r.h for r in train.where(eligible).select(mark.alias("h")).distinct().orderBy("h").limit(rows).collect()]
    if not marks:
        return [], train
    chosen = eligible & (mark <= marks[-1])
    texts = train.where(chosen).select(content.alias("t"), mark.alias("h")).groupBy("h", "t").agg(F.count(F.lit(1)).alias("n")).orderBy("h", "t").collect()
    return [(r.t, r.n) for r in texts], train.where(~chosen)


def learned(train: DataFrame, have: np.ndarray, code: Code, text: str = "text") -> Mixer:
    """Tables of all training rows, with the fixed starting weights."""
    shared = train.sparkSession.sparkContext.broadcast((have, code))
    mixer = Mixer(code, bit_tables(bit_counts(train, shared, text), code))
    shared.destroy()  # nothing computes the tables again: they are here
    return mixer


def _frequent(counts: DataFrame, distinct: int, most: int) -> int:
    """The least count whose tokens, with all more frequent ones, are at most `most`."""
    if distinct <= most:
        return 0
    by = counts.groupBy(F.least("c", F.lit(10000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 10,000 rows
    held = 0
    for r in sorted(by, key=lambda r: -r.c):
        held += r.n
        if held > most:
            return r.c + 1
    return 0


def known_tokens(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of tokens(h, c), and their counts. They reach the driver in compressed blocks of arrays rather than as rows."""

    def pack(batches):
        for batch in batches:
            h, c = (batch.column(i).to_numpy() for i in (0, 1))
            blobs = [[pa.compress(x.astype(np.int64).tobytes(), CODEC, asbytes=True)] for x in (h, c)]
            yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["n", "h", "c"])

    blocks = tokens.select("h", "c").mapInArrow(pack, "n int, h binary, c binary").collect()  # at most MAX_VOCAB tokens
    h, c, at = np.zeros(sum(r.n for r in blocks), np.int64), np.zeros(sum(r.n for r in blocks), np.int64), 0
    while blocks:
        r = blocks.pop()
        for into, blob in ((h, r.h), (c, r.c)):
            into[at : at + r.n] = np.frombuffer(pa.decompress(blob, 8 * r.n, CODEC, asbytes=True), np.int64)
        at += r.n
    c = narrow(c)
    order = np.argsort(h)
    c = c[order]
    h.sort()
    return h, c


RESULT = "n_tokens long, n_known long, base double, score double, bits_per_byte double, rest array<struct<h:long,n:long>>"


def score(docs: DataFrame, train: DataFrame, text: str = "text", max_vocab: int = MAX_VOCAB) -> DataFrame:
    """docs(doc_id, text) with doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; train(text): what to learn from."""
    spark = docs.sparkSession
    counts = corpus_counts(train, text)
    seen = np.zeros(257, np.int64)
    for r in counts.where("kind = 1").collect():
        seen[r.h] = r.c
    tokens = counts.where("kind = 0").select("h", "c")
    size = tokens.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = size.n or 0, size.v
    least = _frequent(tokens, v, max_vocab)
    known = known_tokens(tokens.where(F.col("c") >= least))
    code = Code(*known, n, seen)
    mixer = learned(train, known[0], code, text)
    shared, whole = spark.sparkContext.broadcast((mixer, known)), least == 0
    floor = math.log10(n + v + 1)

    def run(batches):
        mixer, (have, count) = shared.value
        for batch in batches:
            parts = []
            for data, offsets in row_groups(batch.column(batch.num_columns - 1)):
                rows = len(offsets) - 1
                symbols = Symbols(data, offsets, have, mixer.code)
                h, row = np.append(symbols.token, np.full(rows, END_TOKEN)), np.append(symbols.token_row, np.arange(rows))
                at = np.append(symbols.found, np.repeat(find(have, np.array([END_TOKEN])), rows))
                each = np.where(at >= 0, count[at], 0) if len(count) else np.zeros(len(h), np.int64)
                base = np.bincount(row, np.log10(each.astype(float) + 1) - floor, rows)
                log = mixer.run(symbols, rows) / math.log(10)
                bits = -log * math.log2(10) / np.maximum(1, np.diff(offsets))
                rest: list = [[]] * rows
                if not whole:
                    left = np.flatnonzero(each == 0)
                    pair, many = np.unique(np.stack([row[left], h[left]]), axis=1, return_counts=True)
                    rest = [[] for _ in range(rows)]
                    for r, x, m in zip(pair[0].tolist(), pair[1].tolist(), many.tolist()):
                        rest[r].append({"h": x, "n": m})
                parts.append((np.bincount(row, minlength=rows), np.bincount(row[each > 0], minlength=rows), base, np.round(log, 4), np.round(bits, 6), rest))
            columns = [np.concatenate([p[i] for p in parts]) for i in range(5)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
            rest = [x for p in parts for x in p[5]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in columns), pa.array(rest, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))], [*batch.schema.names[:-1], *(f.split()[0] for f in RESULT.split(", "))])

    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.length(F.coalesce(text, F.lit(""))).alias("size"), text)
    scored = chosen.mapInArrow(run, f"doc_id {kind}, key long, size int, {RESULT}")
    if not whole:
        scored = cut(scored)
        # What a text has of rare tokens follows from the text, so equal texts meet the counts once.
        rare = scored.where(F.size("rest") > 0).dropDuplicates(["key", "size"]).select("key", "size", F.explode("rest").alias("x")).select("key", "size", "x.h", "x.n")
        met = rare.join(tokens.where(F.col("c") < least), "h").groupBy("key", "size").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("add"))
        scored = scored.join(met, ["key", "size"], "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base": F.col("base") + F.coalesce("add", F.lit(0.0))})
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "bits_per_byte")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = score(docs, docs.where(~held_out).select("text"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
