"""BAM files encoded by the tests themselves: splits, regions, blocks that are skipped, and rows equal to those of SAM lines."""

import io
import random
import re
import zlib

import pytest

from strandloom.sources import alignments, bam

CONTIGS = [("c1", 5_000_000), ("c2", 90_000), ("c3", 1000)]
NAMES = [f.split()[0] for f in bam.READS.replace("map<string,string>", "map").split(", ")]


def made(n, seed, long=False):
    draw, rows = random.Random(seed), []
    for k in range(n):
        chrom, size = draw.choice(CONTIGS[:2])
        length = draw.choice([1, 30, 101, 5000]) if long else draw.randint(1, 120)
        placed = draw.random() < 0.9
        cigar = draw.choice([f"{length}M", f"5H{length}M2D", f"{length}M400N"]) if placed else None
        tags = {"NM": str(draw.randint(0, 9)), "RG": "12", "XS": "-70000", "XX": "text with : and spaces"}
        rows.append({
            "bam": None, "rg": "12", "qname": f"r{k}", "flag": 0 if placed else 4, "chrom": chrom if placed else None, "pos": draw.randint(0, size - 7000) if placed else -1, "mapq": draw.randint(0, 60),
            "cigar": cigar, "mate_chrom": draw.choice([None, "c1", "c2"]), "mate_pos": draw.randint(-1, 80_000), "seq": "".join(draw.choice("ACGTN") for _ in range(length)), "qual": draw.choice([None, "".join(chr(draw.randint(33, 73)) for _ in range(length))]), "nm": int(tags["NM"]), "tags": tags,
        })
    return sorted(rows, key=lambda r: (r["chrom"] is None, r["chrom"] or "", r["pos"]))


def stored(rows, folder, name="x.bam", block=0xFF00, index=True, text=None):
    out = io.BytesIO()
    writer = bam.BamWriter(out, CONTIGS, block, *([text] if text else []))
    for r in rows:
        writer.add(r)
    known = writer.close()
    (folder / name).write_bytes(out.getvalue())
    if index:
        (folder / f"{name}.bai").write_bytes(known)
    return str(folder / name)


def sam_line(r):
    text = lambda v: "*" if v is None else str(v)
    tags = [f"{k}:{'i' if re.fullmatch(r'-?[0-9]+', v) and k != 'RG' else 'Z'}:{v}" for k, v in r["tags"].items()]
    return "\t".join([r["qname"], str(r["flag"]), text(r["chrom"]), str(r["pos"] + 1), str(r["mapq"]), text(r["cigar"]), text(r["mate_chrom"]), str(r["mate_pos"] + 1), "0", text(r["seq"]), text(r["qual"]), *tags])


def plain(row):
    return tuple(tuple(sorted(row[c].items())) if isinstance(row[c], dict) else row[c] for c in NAMES[1:])


def direct(path, **options):
    reader = bam.BamReader({"path": path, **{k: str(v) for k, v in options.items()}})
    splits = reader.partitions()
    rows = [r for s in splits for b in reader.read(s) for r in b.to_pylist()]
    return [{**r, "tags": dict(r["tags"])} for r in rows], reader, splits


@pytest.mark.parametrize("block,split", [(0xFF00, 1 << 30), (0xFF00, 70_000), (700, 5000), (97, 1000)])
@pytest.mark.parametrize("long", [False, True])
def test_splits_give_every_record_once(tmp_path, block, split, long):
    rows = made(1500 if block > 700 else 400, 1, long)
    got, _, splits = direct(stored(rows, tmp_path, block=block), splitbytes=split)
    assert [plain(r) for r in got] == [plain(r) for r in rows]
    assert split > 1 << 20 or len(splits) > 1


def test_a_header_longer_than_splits_and_an_empty_file(tmp_path):
    rows = made(200, 2)
    long = "@CO\t" + "".join(random.Random(3).choice("abcdefghij") for _ in range(200_000)) + "\n"
    got, _, _ = direct(stored(rows, tmp_path, text=long, block=3000), splitbytes=4000)
    assert [plain(r) for r in got] == [plain(r) for r in rows]
    assert direct(stored([], tmp_path, "empty.bam"))[0] == []


@pytest.mark.parametrize("region", ["c1:1000000-1200000", "c2:0-400", "c2", "c3:0-1000", "c1:4999999-5000000", "elsewhere:1-2"])
def test_regions_skip_blocks(tmp_path, region):
    rows = made(6000, 4)
    path = stored(rows, tmp_path, block=2000)
    chrom, start, end = bam.region_of(region)
    want = [plain(r) for r in rows if r["chrom"] == chrom and r["pos"] < end and r["pos"] + max(1, bam.reference_length(r["cigar"])) > start]
    got, reader, _ = direct(path, region=region)
    assert [plain(r) for r in got] == want
    _, whole, _ = direct(path)
    assert reader.read_blocks < whole.read_blocks * (0.75 if region == "c2" else 0.3)
    # Without an index, all is read and the same comes back.
    assert [plain(r) for r in direct(stored(rows, tmp_path, "plain.bam", index=False), region=region)[0]] == want


def test_broken_files(tmp_path):
    path = tmp_path / "bad.bam"
    data = bytearray(open(stored(made(500, 5), tmp_path), "rb").read())
    data[-60] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises((ValueError, zlib.error)):
        direct(str(path))
    path.write_bytes(bytes(data[: len(data) // 2]))
    with pytest.raises((ValueError, zlib.error)):
        direct(str(path))
    with pytest.raises(FileNotFoundError):
        direct(str(tmp_path / "none.bam"))


def test_tags_of_all_kinds():
    data = b"AAAx" + b"BBc\xff" + b"CCS\x10\x27" + b"DDf\x00\x00\xc0\x3f" + b"EEZab:c\0" + b"FFBs\x02\x00\x00\x00\x01\x00\xfe\xff" + b"GGH1A\0"
    assert dict(bam._tags(data)) == {"AA": "x", "BB": "-1", "CC": "10000", "DD": "1.5", "EE": "ab:c", "FF": "s,1,-2", "GG": "1A"}


def test_cigars_beyond_the_field(tmp_path):
    cigar = "1M1I" * 40_000
    row = {**made(1, 6)[0], "chrom": "c1", "pos": 5, "flag": 0, "cigar": cigar, "seq": "AC" * 40_000, "qual": None}
    got, _, _ = direct(stored([row], tmp_path))
    assert got[0]["cigar"] == cigar and got[0]["seq"] == row["seq"]


def test_spark_reads_what_sam_lines_say_and_writes_it_again(spark, tmp_path):
    rows = made(3000, 7)
    path = stored(rows, tmp_path)
    got = bam.read_bam(spark, path, split_bytes=20_000)
    assert got.rdd.getNumPartitions() > 3
    want = alignments.sam_reads(spark.createDataFrame([("@HD\tVN:1.6",), *((sam_line(r),) for r in rows)], "value string"))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    as_rows = lambda df: sorted(map(repr, (plain(r.asDict()) for r in df.collect())))
    assert as_rows(got) == as_rows(want)
    contigs = spark.createDataFrame(CONTIGS, "chrom string, length int")
    done = bam.write_bam(want.repartition(5), contigs, str(tmp_path / "out"), 4)
    assert done.groupBy().sum("n_reads").first()[0] == len(rows) and done.count() == 4
    assert as_rows(bam.read_bam(spark, str(tmp_path / "out"))) == as_rows(want)
    near = bam.read_bam(spark, str(tmp_path / "out"), "c1:1000000-1200000")
    assert as_rows(near) == sorted(repr(plain(r)) for r in rows if r["chrom"] == "c1" and r["pos"] < 1_200_000 and r["pos"] + bam.reference_length(r["cigar"]) > 1_000_000)
    assert bam.write_bam(want.limit(0), contigs, str(tmp_path / "none"), 2).count() == 0
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_filters_become_a_region(spark, tmp_path):
    rows = made(3000, 8)
    path = stored(rows, tmp_path, block=2000)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = sorted(r.qname for r in bam.read_bam(spark, path).where("chrom = 'c1' and pos >= 100000 and pos < 900000").collect())
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert got == sorted(r["qname"] for r in rows if r["chrom"] == "c1" and 100_000 <= r["pos"] < 900_000)
