"""Deterministic sharded WARC writer and its reader.

Pages are ranged by page_id into shards of about equal payload, whose bounds come from a histogram of the data and
not from partitions; a range too heavy to cut by id (repeated or null ids) is dealt on by digest and url. Within a shard,
records go out in order of page_id and digest, each a gzip member of its own, and a file ends when its compressed
size reaches ROLL_BYTES. Headers, record ids and digests derive from the page alone, so every run writes the same
bytes. A file is written under a temporary name of its task attempt and then renamed; the manifest, written last by
Spark's own committer, lists what counts, and readers read only that. A repeated attempt renames the same bytes.

Files are reached through pyarrow.fs, so any folder that it and Spark both open will do.

Defined cases: a null html is an empty payload; a null page_id or url leaves its header out; rows that share the largest
page_id of a payload are all responses; a group without any page_id is all responses; an empty table writes no file.
Only page_id, url and html are read, so other columns' names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, table

REVISIT_BYTES = 1000
ROLL_BYTES, SHARD_BYTES, LEAST_SHARDS, BINS = 64 << 20, 64 << 20, 64, 4096
MAX_BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string, first_page_id long, last_page_id long"


def _urn(*key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(key))}>"


def _field(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit, whose block is empty, if refers_to is given."""
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_field(url or '')}"] * (url is not None) + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    head += [f"WARC-Payload-Digest: {sha1}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without time or name
    return packer.compress(raw) + packer.flush()


def members(content: bytes):
    """The decompressed records of a file, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            fed = view[at : at + (1 << 16)]
            out.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url); raises if lengths or digests don't hold."""
    head, _, rest = raw.partition(_CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _CRLF * 2:
        raise ValueError("a record's length doesn't hold")
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("a block's digest doesn't hold")
    digest, size = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(_CRLF * 2)[2]
        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError("a payload's digest doesn't hold")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI")


def with_shards(records: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """records(page_id, url, size, digest, ...) with their shard; and the number of shards.

    Ranges of equal width are weighed first; those heavier than a shard and than an even share are cut again between the ids
    that they really hold, so single outlying ids don't make one range of the rest. The driver gets a row for each range, of
    which a pass adds 16 * BINS / 4 at most; every pass separates the least and largest id of a range, and ends with single ids.
    """
    ends = records.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.sum(F.col("size") + 512).alias("n")).first()
    if not ends.n:
        return records.withColumn("shard", F.lit(0)), 1
    shard_bytes = max(1, min(shard_bytes, ends.n // LEAST_SHARDS))
    heaviest = max(shard_bytes, 4 * ends.n // BINS)
    spark, id_ = records.sparkSession, F.col("page_id")
    weigh = lambda rows: {r.bin: (r.n, r.a, r.b) for r in rows.groupBy("bin").agg(F.sum(F.col("size") + 512).alias("n"), F.min("page_id").alias("a"), F.max("page_id").alias("b")).collect()}
    # Bin 0 is of null ids, bin 1 of all others, until it is cut.
    dealt = records.withColumn("bin", F.when(id_.isNull(), 0).otherwise(1))
    bins = {1: (ends.n, ends.a, ends.b)} if ends.a is not None else {}
    used, first_pass = 2, True
    while heavy := [b for b, (n, low, high) in bins.items() if b and low < high and (first_pass or n > heaviest)]:
        parts = max(16, BINS // len(heavy))
        # Subtraction of whole numbers is exact; ranges too wide for it are cut by doubles, which keep the order too.
        cuts = [(b, bins[b][1], bins[b][2] - bins[b][1] >= 1 << 62, float(bins[b][2] - bins[b][1]), used + i * parts) for i, b in enumerate(heavy)]
        table_ = spark.createDataFrame(cuts, "bin int, low long, wide boolean, span double, base int")
        offset = F.when(F.col("wide"), id_.cast("double") - F.col("low").cast("double")).otherwise(F.try_subtract(id_, F.col("low")).cast("double"))
        spot = F.col("base") + F.least(F.lit(parts - 1), F.floor(offset / F.col("span") * parts)).cast("int")
        dealt = dealt.join(F.broadcast(table_), "bin", "left").withColumn("bin", F.coalesce(spot, "bin")).drop("low", "wide", "span", "base")  # at most BINS / 4 rows
        bins = {b: v for b, v in bins.items() if b not in heavy} | weigh(dealt.where((F.col("bin") >= used) | (F.col("bin") == 0)))
        used, first_pass = used + parts * len(heavy), False
    if first_pass:
        bins = weigh(dealt)
    rows, shard, filled = [], 0, 0
    for b, (n, *_) in sorted(bins.items(), key=lambda x: (x[0] > 0, x[1][1] or 0)):
        if filled and filled + n > shard_bytes:
            shard, filled = shard + 1, 0
        ways = -(-n // shard_bytes) if n > shard_bytes else 1
        rows.append((b, shard, ways))
        shard, filled = (shard + ways, 0) if ways > 1 else (shard, filled + n)
    met = dealt.join(F.broadcast(spark.createDataFrame(rows, "bin int, first int, ways int")), "bin")  # as many rows as ranges
    return met.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("digest", "url"), F.col("ways")).cast("int")).drop("bin", "first", "ways"), shard + 1


def records_of(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, refers_to (null: a response) of pages(page_id, url, html)."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("*", F.octet_length("html").cast("long").alias("size"), F.sha1(F.encode("html", "utf-8")).alias("digest"))
    # Only payloads that occur twice take part in the join; their copies are counted before they meet. While they are
    # at most MAX_BROADCAST_ROWS digests of 40 letters, pages needn't be shuffled for it.
    repeated = body.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated)
    met = body.join(F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_ROWS else repeated, "digest", "left")
    return met.select("page_id", "url", "html", "size", "digest", F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Archives of pages(page_id, url, html) in folder/data; returns the manifest, read from folder/manifest."""
    spark = pages.sparkSession
    records, shards = with_shards(records_of(pages), shard_bytes)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(f"{folder}/data")
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard = seq = None
        held: list[bytes] = []
        filled, ids, rows = 0, [], []

        def close() -> None:
            nonlocal seq, filled
            if not held:
                return
            data = b"".join(held)
            name = f"part-{shard:06d}-{seq:05d}.warc.gz"
            with fs.open_output_stream(f"{root}/_{name}.{attempt}") as out:
                out.write(data)
            fs.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
            known = [x for x in ids if x is not None]
            rows.append((shard, seq, name, len(ids), len(data), hashlib.sha256(data).hexdigest(), min(known, default=None), max(known, default=None)))
            held.clear(), ids.clear()
            seq, filled = seq + 1, 0

        for batch in batches:
            for page_id, url, html, digest, refers_to, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "shard"))):
                if at != shard:
                    close()
                    shard, seq = at, 0
                held.append(_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)))
                filled += len(held[-1])
                ids.append(page_id)
                if filled >= roll_bytes:
                    close()
        close()
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in MANIFEST.split(", ")])

    laid = records.repartition(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    laid.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """READ of every record in the files that the manifest lists, each verified."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if listed.isEmpty():
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed.select("file", "sha256"), "file").select("content", "sha256")

    def run(batches):
        for batch in batches:
            for content, sha256 in zip(batch.column("content"), batch.column("sha256")):
                data = content.as_py()
                if hashlib.sha256(data).hexdigest() != sha256.as_py():
                    raise ValueError("a file isn't what its manifest says")
                rows = list(zip(*(parse(x) for x in members(data))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [f.split()[0] for f in READ.split(", ")])

    return named.mapInArrow(run, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, octet_length(encode(html)) AS n FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
