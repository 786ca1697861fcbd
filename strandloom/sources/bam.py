"""BAM files as a data source of Spark, read in splits and by region, and a writer of sorted, indexed files.

A file is a chain of compressed blocks of at most 64 kB, and records run across them. A split is a range of bytes: it begins with
the first record that starts in a block of its range and ends with the last one. Where a record starts is told from the
records themselves: every field must fit, and so must all that follow within two blocks. With a region, the index beside
a file (.bai) names the stretches that may hold its reads, and only those blocks are read.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load(path)                                            # a file or a folder of *.bam
    spark.read.format("bam").option("region", "chr4:1000-2000").load(path)         # 0-based, half-open, reads that overlap it
    spark.read.format("bam").load(path).where("chrom = 'chr4' and pos < 2000")     # pushed into the index with option pushFilters, which spark.sql.python.filterPushdown.enabled must allow

Rows are as of `alignments.sam_reads`, with the file as bam.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.lineage import cut
from ..operators.names import free

READS = "bam string, rg string, qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, seq string, qual string, nm int, tags map<string,string>"
SPLIT_BYTES, BATCH_ROWS, READ_AT_ONCE, WINDOW = 64 << 20, 4096, 1 << 20, 1 << 17
# Fixed values of the format: letters of four bits, operations, sizes and formats of numbers, the last block of a file.
LETTERS, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_HEX_TO_LETTER = str.maketrans("0123456789abcdef", LETTERS)
_LETTER_TO_HEX = {c: f"{i:x}" for i, c in enumerate(LETTERS)}
_PHRED = bytes((i + 33) & 255 for i in range(256))
_KIND = pa.schema([("bam", pa.string()), ("rg", pa.string()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_chrom", pa.string()), ("mate_pos", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("nm", pa.int32()), ("tags", pa.map_(pa.string(), pa.string()))])


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, name


class Blocks:
    """The blocks of a file from a byte on, decompressed one by one."""

    def __init__(self, source, at: int = 0):
        self.source, self.at, self.held, self.base = source, at, b"", at
        self.read_blocks = 0

    def _bytes(self, at: int, n: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.held):
            self.source.seek(at)
            self.held, self.base = self.source.read(max(n, READ_AT_ONCE)), at
        return self.held[at - self.base : at - self.base + n]

    def size_at(self, at: int) -> int:
        """Bytes of the block at a byte; 0 if there is none."""
        head = self._bytes(at, 18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra = self._bytes(at + 12, struct.unpack_from("<H", head, 10)[0])
        k = 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(extra):
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        return 0

    def find(self, until: int) -> bool:
        """Goes on to the first block before `until` that others follow; False if there is none."""
        while self.at < until:
            here = self._bytes(self.at, 1 << 16)
            if not here:
                return False
            k = here.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                self.at += max(1, len(here) - 3)
                continue
            self.at += k
            at, chained = self.at, 0
            while chained < 4 and (n := self.size_at(at)):
                at, chained = at + n, chained + 1
            if self.at < until and chained and (chained == 4 or not self._bytes(at, 1)):
                return True
            self.at += 1
        return False

    def next(self) -> tuple[int, bytes] | None:
        """(byte at which it begins, content) of the next block; None at the end."""
        n = self.size_at(self.at)
        if not n:
            if self._bytes(self.at, 1):
                raise ValueError("not a block of a BAM file")
            return None
        raw, at = self._bytes(self.at, n), self.at
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[skip:-8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", raw, n - 8)[0]:
            raise ValueError("a block's checksum doesn't hold")
        self.at += n
        self.read_blocks += 1
        return at, data


class Stream:
    """Decompressed bytes from a block on, with the place of each: (byte of its block, offset in it)."""

    def __init__(self, blocks: Blocks, skip: int = 0):
        self.blocks, self.data, self.at = blocks, bytearray(), 0
        self.starts: list[tuple[int, int]] = []  # (offset in data, byte of the block)
        if self.more():
            self.at = skip

    def more(self) -> bool:
        got = self.blocks.next()
        if got is None:
            return False
        self.starts.append((len(self.data), got[0]))
        self.data += got[1]
        return True

    def has(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def place(self) -> tuple[int, int]:
        if self.at >= len(self.data):
            self.more()
        k = next(i for i in range(len(self.starts) - 1, -1, -1) if self.starts[i][0] <= self.at)
        return self.starts[k][1], self.at - self.starts[k][0]

    def forget(self) -> None:
        """Drops what lies before the current block."""
        k = max((i for i, (o, _) in enumerate(self.starts) if o <= self.at), default=0)
        drop = self.starts[k][0] if self.starts else 0
        del self.data[:drop]
        self.at -= drop
        self.starts = [(o - drop, b) for o, b in self.starts[k:]]

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("a BAM file is cut off")
        out = bytes(self.data[self.at : self.at + n])
        self.at += n
        return out


@dataclass
class Header:
    text: str
    contigs: list[tuple[str, int]]
    first: tuple[int, int] = (0, 0)  # the place of the first record


def header_of(stream: Stream) -> Header:
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return Header(text, contigs, stream.place())


def _fits(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int:
    """The size of the record that could be at this offset, whose head is in data; 0 if there can't be one."""
    size, ref, pos, name, _, _, ops, _, letters, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    ends = [10**10 if r < 0 else contigs[r][1] if r < len(contigs) else -2 for r in (ref, mate)]
    if size < 32 + name + 4 * ops + (max(0, letters) + 1) // 2 + letters or letters < 0 or not name or size > 1 << 28:
        return 0
    if ref < -1 or mate < -1 or not -1 <= pos <= ends[0] or not -1 <= mate_pos <= ends[1]:
        return 0
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return 0
    return size + 4


def first_record(stream: Stream, contigs: list[tuple[str, int]], until: int) -> bool:
    """Goes on to the first record that starts in a block before byte `until`: one from which records fit for two blocks, or to the end."""
    while stream.has(36) and stream.place()[0] < until:
        at = stream.at
        while stream.has(at - stream.at + 36) and at - stream.at < WINDOW and (n := _fits(stream.data, at, contigs)):
            at += n
        if at - stream.at >= WINDOW or at == len(stream.data) > stream.at:
            return True
        stream.at += 1
    return False


def _tags(data: bytes) -> Iterator[tuple[str, str]]:
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield name, data[at:end].decode()
            at = end + 1
        elif kind == "A":
            yield name, chr(data[at])
            at += 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            yield name, ",".join([of, *(f"{v:g}" if of == "f" else str(v) for v in values)])
            at += 5 + n * struct.calcsize(NUMBERS[of])
        else:
            (value,) = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)
            yield name, f"{value:g}" if kind == "f" else str(value)
            at += struct.calcsize(NUMBERS[kind])


def _cigar(numbers: Iterable[int]) -> str | None:
    return "".join(f"{n >> 4}{OPERATIONS[n & 15]}" for n in numbers) or None


def decoded(body: bytes, contigs: list[tuple[str, int]], file: str) -> tuple:
    """A row of READS of a record without its size."""
    ref, pos, name, mapq, _, ops, flag, letters, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", body, 0)
    at = 32 + name
    cigar = _cigar(struct.unpack_from(f"<{ops}I", body, at))
    at += 4 * ops
    seq = body[at : at + (letters + 1) // 2].hex().translate(_HEX_TO_LETTER)[:letters]
    at += (letters + 1) // 2
    qual = body[at : at + letters]
    tags: dict[str, str] = {}
    for k, v in _tags(body[at + letters :]):
        tags.setdefault(k, v)
    if cigar and "CG" in tags and re.fullmatch(r"\d+S\d+N", cigar):  # too many operations for their field
        cigar = _cigar(int(x) for x in tags.pop("CG").split(",")[1:])
    at_ = lambda r: contigs[r][0] if r >= 0 else None
    text = body[32 : 31 + name].decode()
    return (
        file, tags.get("RG"), None if text == "*" else text, flag, at_(ref), pos, mapq, cigar, at_(mate), mate_pos, seq or None, None if not letters or qual[0] == 255 else qual.translate(_PHRED).decode("latin-1"),
        int(tags["NM"]) if re.fullmatch(r"-?\d+", tags.get("NM", "")) else None, list(tags.items()),
    )


def reference_length(cigar: str | None) -> int:
    return sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cigar or ""))


# --- index ---


def bins_of(start: int, end: int) -> list[int]:
    """The bins of the index that may hold reads of a half-open region."""
    out = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out += range(first + (start >> shift), first + (max(start, end - 1) >> shift) + 1)
    return out


def bin_of(start: int, end: int) -> int:
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


@dataclass
class Index:
    """Of each contig: bins with stretches of places, and the least place of each window of 16 kB. A place is byte << 16 | offset."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]

    def stretches(self, contig: int, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches of the file that hold all reads overlapping the region, in order and merged."""
        if contig >= len(self.bins):
            return []
        held, windows = self.bins[contig], self.windows[contig]
        least = windows[min(start >> 14, len(windows) - 1)] if windows else 0
        found = sorted((max(a, least), b) for k in bins_of(start, end) for a, b in held.get(k, ()) if b > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a >> 16 <= (out[-1][1] >> 16) + 1:
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
        return out


def index_of(data: bytes) -> Index:
    if data[:4] != b"BAI\x01":
        raise ValueError("not an index of a BAM file")
    at = 8
    out = Index([], [])
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            k, m = struct.unpack_from("<Ii", data, at)
            pairs = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
            at += 8 + 16 * m
            if k < 37450:  # the bin behind the last one holds counts
                bins[k] = list(zip(pairs[::2], pairs[1::2]))
        (n,) = struct.unpack_from("<i", data, at)
        out.windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
        out.bins.append(bins)
        at += 4 + 8 * n
    return out


def index_bytes(index: Index) -> bytes:
    out = [b"BAI\x01", struct.pack("<i", len(index.bins))]
    for bins, windows in zip(index.bins, index.windows):
        out.append(struct.pack("<i", len(bins)))
        for k, pairs in sorted(bins.items()):
            out.append(struct.pack(f"<Ii{2 * len(pairs)}Q", k, len(pairs), *(x for p in pairs for x in p)))
        out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    return b"".join(out)


# --- source ---


@dataclass
class Split(InputPartition):
    """Records that start in blocks of bytes [first, last), or, with places, in those stretches; of a region, if there is one."""

    path: str
    first: int = 0
    last: int = 0
    places: list[tuple[int, int]] | None = None
    region: tuple[str, int, int] | None = None
    contigs: list[tuple[str, int]] = field(default_factory=list)
    begin: tuple[int, int] = (0, 0)

    def __post_init__(self):
        super().__init__(0)


def region_of(text: str) -> tuple[str, int, int]:
    """(chrom, start, end) of `chrom` or `chrom:start-end`."""
    found = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
    return (found[1], int(found[2]), int(found[3])) if found else (text, 0, 1 << 29)


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.region = region_of(options["region"]) if options.get("region") else None
        self.read_blocks = 0

    def files(self) -> list[tuple[str, int]]:
        out = []
        for path in self.paths:
            fs, name = _open(path)
            info = fs.get_file_info(name)
            if info.type == pafs.FileType.Directory:
                root = path.rstrip("/")
                out += sorted((f"{root}/{f.base_name}", f.size) for f in fs.get_file_info(pafs.FileSelector(name)) if f.base_name.endswith(".bam") and f.base_name[0] not in "_.")
            elif info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            else:
                out.append((path, info.size))
        return out

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        for path, size in self.files():
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                head = header_of(Stream(Blocks(f)))
            made = self._of_region(path, fs, name, head) if self.region else None
            if made is None:
                made = [Split(path, a, min(size, a + self.split_bytes), None, self.region, head.contigs, head.first) for a in range(0, size, self.split_bytes) if a + self.split_bytes > head.first[0]]
            out += made
        return out or [Split("")]

    def _of_region(self, path: str, fs, name: str, head: Header) -> list[Split] | None:
        """Splits by the index; None without one."""
        known = next((n for n in (name + ".bai", re.sub(r"\.bam$", ".bai", name)) if fs.get_file_info(n).type == pafs.FileType.File), None)
        numbers = {c: k for k, (c, _) in enumerate(head.contigs)}
        if self.region[0] not in numbers:
            return []
        if known is None:
            return None
        with fs.open_input_file(known) as f:
            index = index_of(f.read())
        out, held, size = [], [], 0
        for a, b in index.stretches(numbers[self.region[0]], *self.region[1:]):
            held.append((a, b))
            size += (b >> 16) - (a >> 16) + 1
            if size >= self.split_bytes:
                out.append(held)
                held, size = [], 0
        return [Split(path, places=p, region=self.region, contigs=head.contigs) for p in [*out, held] if p]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KIND)], schema=_KIND)
            rows.clear()
            return out

        if split.path:
            fs, name = _open(split.path)
            with fs.open_input_file(name) as f:
                for body in self._records(f, split):
                    row = decoded(body, split.contigs, split.path)
                    if split.region and not (row[4] == split.region[0] and row[5] < split.region[2] and row[5] + max(1, reference_length(row[7])) > split.region[1]):
                        continue
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield batch()
        if rows:
            yield batch()

    def _records(self, source, split: Split) -> Iterator[bytes]:
        for begin, end in split.places if split.places is not None else [(None, None)]:
            if begin is not None:
                stream, stop = Stream(Blocks(source, begin >> 16), begin & 0xFFFF), (end >> 16, end & 0xFFFF)
            else:
                stop = split.last, 0
                if split.begin[0] >= split.first:
                    stream = Stream(Blocks(source, split.begin[0]), split.begin[1])
                else:
                    blocks = Blocks(source, split.first)
                    if not blocks.find(split.last):
                        continue
                    stream = Stream(blocks)
                    if not first_record(stream, split.contigs, split.last):
                        self.read_blocks += blocks.read_blocks
                        continue
            while stream.has(4) and stream.place() < stop:
                yield stream.take(struct.unpack("<i", stream.take(4))[0])
                stream.forget()
            self.read_blocks += stream.blocks.read_blocks


class PushingReader(BamReader):
    """A reader to which Spark may push filters; the session must allow it, so it is asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """chrom = x with bounds on pos becomes a region, if none is given; Spark checks all filters again."""
        chrom, low, high = None, 0, 1 << 29
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "chrom" and isinstance(f, EqualTo):
                chrom = f.value
            elif name == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, int(f.value))
            if name == "pos" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, int(f.value) + 1)
        if chrom is not None and self.region is None:
            self.region = chrom, low, max(low + 1, high)
        return filters


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema: T.StructType) -> BamReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushfilters", options.get("pushFilters")) == "true" else BamReader)(options)


def read_bam(spark: SparkSession, path: str, region: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of a file, a folder or a comma-separated list of them; of a region only those that overlap it."""
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("splitBytes", str(split_bytes)).option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (source.option("region", region) if region else source).load(path)


# --- writer ---


def encoded(row: dict[str, Any], numbers: dict[str, int]) -> bytes:
    """A record with its size of a row of READS; null, or a contig that isn't listed, is none."""
    cigar = re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")
    seq, name = row["seq"] or "", (row["qname"] or "*").encode()
    pos, end = row["pos"] if row["pos"] is not None else -1, 0
    end = pos + max(1, reference_length(row["cigar"]))
    ops = [int(n) << 4 | OPERATIONS.index(op) for n, op in cigar]
    tags = b""
    for key, value in (row["tags"] or {}).items() if isinstance(row["tags"], dict) else row["tags"] or ():
        whole = re.fullmatch(r"-?\d{1,9}", value) and key not in ("RG", "MD", "SA", "XA", "PG", "BC")
        tags += key.encode() + (b"i" + struct.pack("<i", int(value)) if whole else b"Z" + value.encode() + b"\0")
    if len(ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, (end - pos) << 4 | 3]
    digits = "".join(_LETTER_TO_HEX.get(c, "f") for c in seq.upper())
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] and len(row["qual"]) == len(seq) else b"\xff" * len(seq)
    number = lambda c: numbers.get(c, -1) if c is not None else -1
    mate_pos = row["mate_pos"] if row["mate_pos"] is not None else -1
    body = struct.pack("<iiBBHHHiiii", number(row["chrom"]), pos, len(name) + 1, row["mapq"] or 0, bin_of(max(0, pos), max(1, end)), len(ops), row["flag"] or 0, len(seq), number(row["mate_chrom"]), mate_pos, 0)
    body += name + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes.fromhex(digits + "0" * (len(digits) % 2)) + qual + tags
    return struct.pack("<i", len(body)) + body


class BamWriter:
    """Blocks and an index of records that come in order of contig and position, unplaced ones last."""

    def __init__(self, out, contigs: list[tuple[str, int]], block: int = 0xFF00, text: str = "@HD\tVN:1.6\tSO:coordinate\n"):
        self.out, self.block, self.held, self.at, self.size = out, block, bytearray(), 0, 0
        self.numbers = {c: k for k, (c, _) in enumerate(contigs)}
        self.index = Index([{} for _ in contigs], [[] for _ in contigs])
        text += "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
        self._put(b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs))
        self._flush()

    def _put(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.block:
            self._flush()

    def _flush(self) -> None:
        data = bytes(self.held[: self.block])
        del self.held[: self.block]
        if data:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(data) + packer.flush()
            self._write(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data)))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _place(self) -> int:
        return self.at << 16 | len(self.held)

    def add(self, row: dict[str, Any]) -> None:
        begin = self._place()
        self._put(encoded(row, self.numbers))
        contig = self.numbers.get(row["chrom"], -1) if row["chrom"] is not None else -1
        if contig < 0 or row["pos"] is None or row["pos"] < 0:
            return
        start, stop = row["pos"], row["pos"] + max(1, reference_length(row["cigar"]))
        pairs, windows = self.index.bins[contig].setdefault(bin_of(start, stop), []), self.index.windows[contig]
        if pairs and pairs[-1][1] == begin:
            pairs[-1] = pairs[-1][0], self._place()
        else:
            pairs.append((begin, self._place()))
        for k in range(start >> 14, ((stop - 1) >> 14) + 1):
            while len(windows) <= k:
                windows.append(0)
            windows[k] = windows[k] or begin

    def close(self) -> bytes:
        """Ends the file; returns the bytes of its index."""
        while self.held:
            self._flush()
        self._write(END_OF_FILE)
        for windows in self.index.windows:
            for k in range(1, len(windows)):  # a window without reads of its own begins where the one before does
                windows[k] = windows[k] or windows[k - 1]
        return index_bytes(self.index)


WRITTEN = "file string, n_reads long, bytes long"


def write_bam(reads: DataFrame, contigs: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Sorted files with indexes in a folder; returns (file, n_reads, bytes) of each. reads as of READS, contigs(chrom, length), whose
    order by name is that of the files, one behind the other; unplaced reads come last.

    Ranges of position are one file each (the number of shuffle partitions, if not given). A task writes under a temporary name and renames, so one
    that runs again leaves the same file. An empty table leaves an empty folder. The list of contigs is short and goes to every task. Columns beyond READS are left out.
    """
    listed = [(r.chrom, r.length) for r in contigs.select("chrom", F.col("length").cast("int").alias("length")).distinct().orderBy("chrom").collect()]
    names = [f.name for f in T._parse_datatype_string(READS)]
    (rank,) = free(reads, "rank")
    known = reads.sparkSession.createDataFrame([(c, k) for k, (c, _) in enumerate(listed)], f"chrom string, {rank} int")  # a row for each contig
    ranked = reads.select(*names).join(F.broadcast(known), "chrom", "left").withColumn(rank, F.coalesce(rank, F.lit(len(listed))))
    order = [rank, "pos", "qname", "flag", "cigar", "seq"]
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    n = files or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        fs, root = _open(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.bam"
        temporary, rows = f"{root}/_{name}.{task.taskAttemptId()}", 0
        with fs.open_output_stream(temporary) as out:
            writer = BamWriter(out, listed)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in names)):
                    writer.add(dict(zip(names, row)))
                    rows += 1
            index = writer.close()
        with fs.open_output_stream(f"{temporary}.bai") as out:
            out.write(index)
        fs.move(f"{temporary}.bai", f"{root}/{name}.bai")
        fs.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder.rstrip('/')}/{name}"], "n_reads": [rows], "bytes": [writer.at]})

    # The files are what the job is for, so it runs here, once.
    return cut(ranked.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order).mapInArrow(run, WRITTEN))
