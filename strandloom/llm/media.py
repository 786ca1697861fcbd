"""Media columns and signature sniffing.

`store` keeps bytes losslessly as 8-bit mono samples of a WAVE file. `sniff` trusts no declared type: an Aho-Corasick
automaton finds the magic bytes of all formats in one pass over a blob, a validator for each format walks its
structure and returns its length (of chains that many beginnings lead to, every step once), and so the blob's type is corrected and every embedded piece of media is carved.

All work is on one row's bytes, so nothing is shuffled and memory follows one blob.

Defined cases: a null blob or text is empty; a signature without valid structure is no media; equal bytes give equal
values; of pieces that overlap, the one that begins first stays, then the longer; a column named as the output is
replaced; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table

BLOCK, RATE = 64, 8000
#: Rows and bytes of one batch of stored media.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
FOUND = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data with bytes 0 up to a positive multiple of block."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def wave(samples: bytes) -> bytes:
    """A WAVE file of 8-bit mono samples; its chunk sizes are 32-bit, which bounds one blob at 4 GiB."""
    odd = len(samples) & 1
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_samples(media: memoryview) -> memoryview:
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _jpeg(b: memoryview) -> tuple[str, int] | None:
    at, scanned, raw = 2, False, b.obj
    base = len(raw) - len(b)  # b is the rest of the blob from its magic on
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xD9:
            return ("image/jpeg", at + 2) if scanned else None
        size = struct.unpack_from(">H", b, at + 2)[0]
        if size < 2 or mark in (0x00, 0xD8):
            return None
        at += 2 + size
        if mark == 0xDA:
            scanned, k = True, raw.find(b"\xff", base + at)
            while 0 <= k < len(raw) - 1 and (raw[k + 1] == 0 or 0xD0 <= raw[k + 1] <= 0xD7):
                k = raw.find(b"\xff", k + 2)
            if k < 0 or k >= len(raw) - 1:
                return None
            at = k - base
    return ("image/jpeg", at + 2) if scanned and bytes(b[at : at + 2]) == b"\xff\xd9" else None


class _Places:
    """Where marks stand in one blob; every mark is sought once, so that many false beginnings cost no more than one."""

    def __init__(self, raw: bytes):
        self.raw, self.known = raw, {}
        self.chunks = _Chains(self._chunk, lambda at: (b"fmt ", b"data").index(raw[at : at + 4]) if raw[at : at + 4] in (b"fmt ", b"data") and at + 8 <= len(raw) else -1)
        self.pieces, self.pages = _Chains(self._piece), _Chains(self._page)
        self.parts, self.frames = _Chains(self._part), _Chains(self._frame)

    def _chunk(self, at: int) -> int:
        """Of RIFF: the next chunk; names of chunks are printable."""
        if at + 8 > len(self.raw) or not all(32 <= c <= 126 for c in self.raw[at : at + 4]):
            return -1
        size = struct.unpack_from("<I", self.raw, at + 4)[0]
        return at + 8 + size + (size & 1)

    def _piece(self, at: int) -> int:
        """Of PNG: behind a chunk whose checksum holds; an end chunk is the last."""
        if at + 12 > len(self.raw) or self.raw[at - 8 : at - 4] == b"IEND" and self.raw[at - 12 : at - 8] == bytes(4):
            return -1
        size = struct.unpack_from(">I", self.raw, at)[0]
        if at + 12 + size > len(self.raw) or zlib.crc32(self.raw[at + 4 : at + 8 + size]) != struct.unpack_from(">I", self.raw, at + 8 + size)[0]:
            return -1
        return at + 12 + size

    def page_size(self, at: int) -> int:
        """Of Ogg: bytes of the page at a place; 0 if there is none."""
        if at + 27 > len(self.raw) or self.raw[at : at + 5] != b"OggS\0":
            return 0
        n = self.raw[at + 26]
        size = 27 + n + sum(self.raw[at + 27 : at + 27 + n])
        return size if at + size <= len(self.raw) and at + 27 + n <= len(self.raw) else 0

    def _page(self, at: int) -> int:
        size = self.page_size(at)
        return at + size if size and not self.raw[at + 5] & 4 else -1

    def _part(self, at: int) -> int:
        """Of GIF: the next block of data; an empty one is the last."""
        return at + self.raw[at] + 1 if at < len(self.raw) and self.raw[at] else -1

    def _frame(self, at: int) -> int:
        """Of GIF: behind an extension or an image."""
        if at + 10 >= len(self.raw) and (at >= len(self.raw) or self.raw[at] == 0x2C) or at >= len(self.raw) or self.raw[at] not in (0x21, 0x2C):
            return -1
        table_ = 0 if self.raw[at] == 0x21 or not self.raw[at + 9] & 0x80 else 3 << (self.raw[at + 9] & 7) + 1
        last = self.parts.last(at + 2 if self.raw[at] == 0x21 else at + 11 + table_)
        return last + 1 if last < len(self.raw) else -1

    def all(self, mark: bytes) -> list[int]:
        if mark not in self.known:
            out, k = [], self.raw.find(mark)
            while k >= 0:
                out.append(k)
                k = self.raw.find(mark, k + 1)
            self.known[mark] = out
        return self.known[mark]

    def first(self, mark: bytes, start: int) -> int:
        places = self.all(mark)
        k = bisect_left(places, start)
        return places[k] if k < len(places) else -1

    def zips(self) -> dict[int, int]:
        """End of the archive that begins at a place, by its end-of-directory record."""
        if "zip" not in self.known:
            out: dict[int, int] = {}
            for end in self.all(b"PK\x05\x06"):
                if end + 22 <= len(self.raw):
                    size, start, note = struct.unpack_from("<IIH", self.raw, end + 12)
                    at = end - start - size
                    if at >= 0 and self.raw[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(self.raw):
                        out.setdefault(at, end + 22 + note)
            self.known["zip"] = out
        return self.known["zip"]


class _Chains:
    """Chains of places in one blob, each a step on from the one before. Chains that meet go on alike, so a step is taken once, however
    many beginnings lead to it; a place keeps where its chain ends and a far place ahead, by which others are found in few leaps."""

    def __init__(self, step: Callable[[int], int], mark: Callable[[int], int] | None = None):
        self.step, self.mark = step, mark
        self.known: dict[int, tuple[int, int, int, int, tuple[int, int]]] = {}  # next (-1: none), leap, depth, last place, marks from here on

    def _go(self, at: int) -> None:
        path = []
        while at not in self.known:
            path.append(at)
            after = self.step(at)
            if after < 0:
                self.known[at] = (-1, at, 0, at, self._marks(at, (0, 0)))
                path.pop()
                break
            at = after
        for at in reversed(path):
            after = self.step(at)
            _, leap, depth, last, marks = self.known[after]
            far = self.known[leap]
            balanced = depth - far[2] == far[2] - self.known[far[1]][2]
            self.known[at] = (after, far[1] if balanced else after, depth + 1, last, self._marks(at, marks))

    def _marks(self, at: int, after: tuple[int, int]) -> tuple[int, int]:
        if self.mark is None:
            return after
        which = self.mark(at)
        return after[0] + (which == 0), after[1] + (which == 1)

    def last(self, at: int) -> int:
        if at not in self.known:
            self._go(at)
        return self.known[at][3]

    def reach(self, at: int, least: int) -> tuple[int, tuple[int, int]] | None:
        """The first place of the chain at `least` or behind, and the marks of the places before it; None if the chain ends before."""
        if self.last(at) < least:
            return None
        begun = self.known[at][4]
        while at < least:
            after, leap = self.known[at][:2]
            at = leap if at < leap < least else after
        there = self.known[at][4]
        return at, (begun[0] - there[0], begun[1] - there[1])


def _riff(places: _Places, at: int) -> tuple[str, int] | None:
    raw = places.raw
    if at + 20 > len(raw):
        return None
    end = at + 8 + struct.unpack_from("<I", raw, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(raw[at + 8 : at + 12])
    if not kind or end > len(raw) or end < at + 20:
        return None
    # The first place from which no chunk fits before the end must be the end itself.
    found = places.chunks.reach(at + 12, end - 7)
    if found is None or found[0] not in (end, end + 1):
        return None
    return (kind, end - at) if kind != "audio/wav" or min(found[1]) > 0 else None


def _png(places: _Places, at: int) -> tuple[str, int] | None:
    raw = places.raw
    if raw[at + 8 : at + 16] != b"\x00\x00\x00\rIHDR":
        return None
    last = places.pieces.last(at + 8)
    return ("image/png", last - at) if raw[last - 8 : last - 4] == b"IEND" and last > at + 33 else None


def _gif(places: _Places, at: int) -> tuple[str, int] | None:
    raw = places.raw
    if at + 13 > len(raw):
        return None
    begin = at + 13 + (3 << (raw[at + 10] & 7) + 1 if raw[at + 10] & 0x80 else 0)
    last = places.frames.last(begin) if begin < len(raw) else -1
    return ("image/gif", last + 1 - at) if 0 <= last < len(raw) and raw[last] == 0x3B else None


def _pdf(places: _Places, at: int) -> tuple[str, int] | None:
    """From its head to the last end mark before the next head."""
    end = places.first(b"%%EOF", at)
    if end < 0 or not places.raw[at + 5 : at + 8].replace(b".", b"").isdigit() or not at < places.first(b"startxref", at) < end:
        return None
    after, ends = places.first(b"%PDF-", at + 5), places.all(b"%%EOF")
    last = ends[bisect_left(ends, after) - 1] if after >= 0 else ends[-1]
    return ("application/pdf", last + 5 - at) if last > at else None


def _zip(places: _Places, at: int) -> tuple[str, int] | None:
    end = places.zips().get(at)
    return ("application/zip", end - at) if end else None


def _ogg(places: _Places, at: int) -> tuple[str, int] | None:
    last = places.pages.last(at)
    size = places.page_size(last)
    return ("audio/ogg", last + size - at) if size and places.raw[last + 5] & 4 else None


def _gzip(b: memoryview) -> tuple[str, int] | None:
    unpack = zlib.decompressobj(31)
    try:
        for at in range(0, len(b), 1 << 16):
            piece = unpack.decompress(b[at : at + (1 << 16)], 1 << 24)
            while unpack.unconsumed_tail and not unpack.eof:
                piece = unpack.decompress(unpack.unconsumed_tail, 1 << 24)
            if unpack.eof:
                return "application/gzip", min(len(b), at + (1 << 16)) - len(unpack.unused_data)
        del piece
    except (zlib.error, UnboundLocalError):
        return None
    return None


#: Magic bytes by format. A validator gets the bytes from the magic on, or the marks of the whole blob and its place.
MAGIC: dict[bytes, Callable[..., tuple[str, int] | None]] = {b"RIFF": _riff, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg, b"%PDF-": _pdf, b"PK\x03\x04": _zip, b"OggS": _ogg, b"\x1f\x8b\x08": _gzip}
_BY_MARKS = (_pdf, _zip, _riff, _png, _gif, _ogg)


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in MAGIC:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def carve(blob: bytes, signatures: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in blob that stand in no other, by offset."""
    view, places, out, after = memoryview(blob), _Places(blob), [], 0
    for last, magic in signatures.iter(blob.decode("latin-1")):
        at = last - len(magic) + 1
        check = MAGIC[magic]
        if at >= after and (found := check(places, at) if check in _BY_MARKS else check(view[at:])):
            out.append((found[0], at, found[1]))
            after = at + found[1]
    return out


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with the text's UTF-8 bytes, padded, as a WAVE file."""
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            media, held, first = [], 0, 0
            for k, x in enumerate(batch.column(text)):
                media.append(wave(padded((x.as_py() or "").encode("utf-8", "surrogatepass"))))
                held += len(media[-1])
                if held >= BATCH_BYTES or len(media) == BATCH_ROWS or k == batch.num_rows - 1:
                    part = batch.slice(first, len(media))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], [*part.schema.names, out])
                    media, held, first = [], 0, k + 1

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


SNIFFED = T.StructType([T.StructField(n, k) for n, k in (("type", T.StringType()), ("corrected", T.BooleanType()), ("found", FOUND))])


def sniff(blobs: DataFrame, content: str = "media", declared: str | None = None, out: str = "sniffed") -> DataFrame:
    """blobs with a struct: the type that the bytes show (null: none), whether the declared one differs, and all media found."""
    blobs = blobs.drop(out)

    def run(batches):
        signatures = automaton()
        kind = pa.struct([("type", pa.string()), ("corrected", pa.bool_()), ("found", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                found = carve(batch.column(content)[i].as_py() or b"", signatures)
                real = found[0][0] if found and found[0][1] == 0 else None
                said = batch.column(declared)[i].as_py() if declared else None
                rows.append({"type": real, "corrected": bool(declared) and said != real, "found": [dict(zip(("type", "offset", "length"), x)) for x in found]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, out])

    return blobs.mapInArrow(run, T.StructType([*blobs.schema.fields, T.StructField(out, SNIFFED)]))


def embedded(blobs: DataFrame, content: str = "media", sniffed: str = "sniffed") -> DataFrame:
    """A row for each piece of media found, with its bytes as `carved`."""
    one = free_name(blobs, "piece")
    rows = blobs.drop("found", "carved").withColumn(one, F.explode(f"{sniffed}.found"))
    return rows.withColumn("carved", F.substring(F.col(content), F.col(f"{one}.offset").cast("int") + 1, F.col(f"{one}.length").cast("int"))).withColumnRenamed(one, "found")


def feature(samples: memoryview) -> str:
    """Count, mean, deviation, entropy of the samples in bits, and most frequent sample."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, at = counts.sum(), np.arange(256)
    mean = (counts * at).sum() / n
    share = counts[counts > 0] / n
    return f"wav8;n={n};mean={mean:.4f};std={((counts * (at - mean) ** 2).sum() / n) ** 0.5:.4f};entropy={-(share * np.log2(share)).sum() + 0:.4f};mode={counts.argmax()}"


DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_embedded long"


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts become media of an unknown type; sniffing finds it, and the samples are read from what it carved. n_embedded
    counts the media found within the samples, as texts may hold some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    found = sniff(store(docs).drop("text").withColumn("declared", F.lit("application/octet-stream")), declared="declared")

    def run(batches):
        signatures = automaton()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                media = batch.column("media")[i].as_py()
                piece = batch.column("sniffed")[i].as_py()["found"][0]
                if piece["type"] != "audio/wav":
                    raise ValueError("stored media weren't recognised")
                carved = memoryview(media)[piece["offset"] : piece["offset"] + piece["length"]]
                samples = wave_samples(carved)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(carved), hashlib.sha256(carved).hexdigest(), feature(samples), len(carve(bytes(samples), signatures))))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *(f.split()[0] for f in DESCRIBED.split(", "))])

    return found.select("doc_id", "n_bytes", "media", "sniffed").mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, " + DESCRIBED)
