"""From split reads to genotyped insertions: clusters, breakends, pairs, filters and counts of reads at sites."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import count_of, has_flag, pair_score
from .clusters import median_cluster, running, sorted_fold
from .consensus import consensus, sampled, trimmed
from .intervals import band_pairs, overlap_join
from .lineage import cut, written
from .names import free
from .reads import DUPLICATE, UNMAPPED, unclipped_start


def sr_clusters(split: DataFrame, distance: int = 100) -> DataFrame:
    """(chrom, first, last, n) of split(chrom, breakpos, middle): clusters by distance to the median, a single read's by its own middle."""
    return median_cluster(split, "chrom", "breakpos", distance, "middle")


def breakends(split: DataFrame, least: int = 1, least_clip: int = 10, most: int = 0, by: str = "bam") -> DataFrame:
    """One row for each (chrom, breakpos, side): n reads, the longest clip, mean match, reads of the fullest sample,
    samples as `sample|n`; admitted by the number of reads and the longest clip."""
    per = split.groupBy("chrom", "breakpos", "side", by).agg(F.count(F.lit(1)).alias("n"), F.max("cliplen").alias("clip"), F.sum("matchpct").alias("s"), F.count("matchpct").alias("m"), F.max("mapq").alias("q"))
    entry = F.concat_ws("|", by, F.col("n").cast("string"))
    # At most one entry for each sample.
    one = per.groupBy("chrom", "breakpos", "side").agg(F.sum("n").alias("n_reads"), F.max("clip").alias("max_clip"), F.try_divide(F.sum("s"), F.sum("m")).alias("avg_match"), F.max("n").alias("max_per_sample"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("samples"), F.max("q").alias("max_mapq"))
    admitted = (F.col("n_reads") >= least) & (F.col("max_clip") >= least_clip)
    return one.where(admitted & (F.col("n_reads") <= most) if most else admitted)


def with_consensus(ends: DataFrame, split: DataFrame, least_score: float = 0.9, most_n: int = 4, most: int = 1000, least_quality: int = 33) -> DataFrame:
    """ends with the consensus of their reads and its score, those left out whose score is lower, whose consensus is empty or has more than most_n letters N.

    split: `reads.split_reads` with seq and qual. Reads go by where they would begin without clips, cut at the first window of low quality; at most `most`
    different sequences of a breakend count (see `consensus.sampled`). A breakend without reads of more than 20 bases has none and goes."""
    keys = ["chrom", "breakpos", "side"]
    (begin,) = free(split, "begin")
    rows = split.select(*keys, unclipped_start().alias(begin), trimmed(F.col("seq"), F.col("qual"), least_quality).alias("seq"))
    made = consensus(sampled(rows, keys, most), keys, [begin], least_score=least_score)
    good = (F.length("consensus") > 0) & (F.col("score") >= least_score) & (count_of(F.upper("consensus"), "N") <= most_n)
    return ends.join(made.where(good).select(*keys, "consensus", F.col("score").alias("consensus_score")), keys)


def breakend_pairs(ends: DataFrame, distance: int = 100, overlap: Column | None = None) -> DataFrame:
    """Scored pairs of a left and a right breakend at most `distance` apart: chrom, left_pos, right_pos, n of each, score.
    overlap: of the two, as an expression over left_pos and right_pos; by default the bases from the left break to the right one."""
    l = ends.where("side = 'left'").select("chrom", F.col("breakpos").alias("pos"), F.col("n_reads").alias("left_n"))
    r = ends.where("side = 'right'").select(F.col("chrom").alias("r_chrom"), F.col("breakpos").alias("r_pos"), F.col("n_reads").alias("right_n"))
    met = band_pairs(l, r, distance).select("chrom", F.col("pos").alias("left_pos"), F.col("r_pos").alias("right_pos"), "left_n", "right_n")
    shared = overlap if overlap is not None else F.greatest(F.lit(0), F.col("right_pos") - F.col("left_pos") + 1)
    return met.withColumn("score", F.round(pair_score(F.col("left_pos"), F.col("right_pos"), shared.cast("double"), F.col("left_n"), F.col("right_n")), 4))


def matched(ends: DataFrame, distance: int = 100, block: int = 1 << 12) -> DataFrame:
    """breakend_pairs that are taken by falling score (then left and right position, as text) if neither breakend is used. A breakend is one row.

    Pairs arise within blocks of positions only, and none is a row. A block doesn't know the partners of breakends near its edges, so these are unsure, and so is any breakend
    that an earlier pair with an unsure one may use; all others are settled. Unsure ones go on to the next turn, in blocks that are
    half a block off, until none is left: the first pair of all lies inside a block in one of two turns, so turns end. block: more than eight distances."""
    if block <= 8 * distance:
        raise ValueError("block must be more than eight distances")
    spark = ends.sparkSession
    d = F.col("id")
    # Of counts only their sum matters, in whole ten-thousandths.
    base = pair_score(F.lit(0), d, F.greatest(F.lit(0), d + 1).cast("double"), F.lit(0), F.lit(0))
    flat = np.array([r[0] for r in spark.range(-distance, distance + 1).orderBy("id").select(F.round(F.round(base, 4) * 10_000).cast("long")).collect()], np.int64)

    def settled(at: np.ndarray, left: np.ndarray, n: np.ndarray, low: int, high: int) -> tuple[bytearray, dict[int, int]]:
        """States of a block's breakends (0 free, 1 unsure, 2 used), and partners of the left ones that are used."""
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        first, last = np.searchsorted(at[r], at[l] - distance), np.searchsorted(at[r], at[l] + distance, "right")
        many = last - first
        a = np.repeat(l, many)
        b = r[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        text = np.unique(at.astype(str), return_inverse=True)[1]
        score = flat[at[b] - at[a] + distance] + 10_000 * (n[a] + n[b])
        order = np.lexsort((text[b], text[a], -score))
        state, partner = bytearray(((at - distance < low) | (at + distance >= high)).astype(np.uint8).tobytes()), {}
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            u, v = state[x], state[y]
            if u == 2 or v == 2:
                continue
            if u or v:
                state[x] = state[y] = 1
            else:
                state[x] = state[y] = 2
                partner[x] = y
        return state, partner

    def fold_of(off: int):
        def fold(stream):
            for (chrom, seat), group in groupby(stream, key=lambda row: row[:2]):
                at, left, n = (np.array(c) for c in list(zip(*group))[2:])
                state, partner = settled(at, left, n, seat * block - off, (seat + 1) * block - off)
                for i in np.flatnonzero(np.frombuffer(state, np.uint8) == 1).tolist():
                    yield chrom, int(at[i]), bool(left[i]), int(n[i]), None, None
                for x, y in partner.items():
                    yield chrom, int(at[x]), True, int(n[x]), int(at[y]), int(n[y])

        return fold

    (seat,) = free(ends, "seat")
    kind = dict(ends.dtypes)["chrom"]
    open_ = ends.select("chrom", F.col("breakpos").cast("long").alias("pos"), (F.col("side") == "left").alias("is_left"), F.col("n_reads").cast("long").alias("n"))
    parts, off = [], 0
    while True:
        dealt = open_.withColumn(seat, F.floor((F.col("pos") + off) / block))
        done = written(sorted_fold(dealt, ["chrom", seat], ["pos", "is_left", "n"], f"chrom {kind}, pos long, is_left boolean, n long, right_pos long, right_n long", fold_of(off)))
        parts.append(done.where("right_pos is not null"))
        open_ = done.where("right_pos is null").select("chrom", "pos", "is_left", "n")
        if open_.isEmpty():
            break
        off = block // 2 - off
    whole = reduce(DataFrame.unionByName, parts).select("chrom", F.col("pos").alias("left_pos"), "right_pos", F.col("n").alias("left_n"), "right_n")
    return whole.withColumn("score", F.round(pair_score(F.col("left_pos"), F.col("right_pos"), F.greatest(F.lit(0), F.col("right_pos") - F.col("left_pos") + 1).cast("double"), F.col("left_n"), F.col("right_n")), 4))


def insertion_reasons(max_mapq: Column, n_split: Column, most_per_sample: Column, n_samples: Column | None = None, excluded: Column | None = None, mappability: Column | None = None, least_mapq: int = 10, least_split: int = 4, most_samples: int = 0, least_mappability: float = 0.1) -> Column:
    """Why an insertion is left out, joined by commas, else PASS: the fullest sample is looked at only if all samples
    together have enough split reads, mappability only if nothing else is wrong."""
    tests = [F.when(max_mapq < least_mapq, "mapq"), F.when(n_split < least_split, "split").when(most_per_sample < least_split, "split_per_sample")]
    if excluded is not None:
        tests.append(F.when(excluded, "excluded"))
    if n_samples is not None and most_samples:
        tests.append(F.when(n_samples > most_samples, "samples"))
    found = F.array_compact(F.array(*tests))
    low = F.lit(False) if mappability is None else F.coalesce(mappability, F.lit(0.0)) < least_mappability
    return F.when(F.size(found) > 0, F.array_join(found, ",")).when(low, "mappability").otherwise("PASS")


#: Bases up to which a read, or a site with what is looked at beside it, is compared pair by pair.
SHORT = 32


def _usable(reads: DataFrame, least_mapq: int) -> DataFrame:
    """The reads that count for sites, with what is asked of them: chrom, pos, ref_end, bam, left and right (clipped bases), plain (as long as their stretch of the reference), alen.
    Kept, as several steps read them; `simple` ones are long, lie behind 0, and aren't both clipped and plain."""
    good = reads.where(~has_flag(F.col("flag"), UNMAPPED) & ~has_flag(F.col("flag"), DUPLICATE) & (F.col("mapq") >= least_mapq))
    slim = good.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("ref_end").cast("long").alias("ref_end"), "bam", "alen", F.col("qstart").alias("left"), (F.col("rlen") - F.col("qend")).alias("right"), (F.col("alen") == F.col("rlen")).alias("plain"))
    simple = (F.col("alen") > SHORT) & (F.col("pos") >= 0) & ~(F.col("plain") & (F.greatest("left", "right") > 0))
    return written(slim.where("chrom is not null and pos is not null and ref_end is not null").withColumn("simple", simple))


def _spots(sites: DataFrame, reach: int) -> DataFrame:
    """(chrom, low, high, narrow): each place of sites once; a narrow one, with reach on both sides, is shorter than any simple read."""
    places = sites.select(F.col("site_chrom").alias("chrom"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).distinct()
    return places.withColumn("narrow", (F.col("high") - F.col("low") + 2 * reach <= SHORT) & (F.col("low") >= 0))


def _paired(usable: DataFrame, spots: DataFrame, pad: int, width: int) -> DataFrame:
    """Pairs of reads and places that overlap within pad, of which one isn't simple or narrow; without such ones no join is made."""
    odd, wide = usable.where("not simple"), spots.where("not narrow")
    some, broad = not odd.isEmpty(), not wide.isEmpty()
    spans = lambda f: f.withColumns({"start": F.col("pos"), "end": F.col("ref_end")})
    put = lambda f: f.select(F.col("chrom").alias("b_chrom"), F.greatest(F.col("low") - pad, F.lit(0)).alias("b_start"), (F.col("high") + pad + 1).alias("b_end"), "low", "high")
    met = [overlap_join(spans(a), put(b), width) for a, b, there in ((odd, spots, some), (usable.where("simple"), wide, broad)) if there]
    out = met[0] if met else spans(odd).join(put(spots).limit(0), F.lit(False))
    return out.unionByName(met[1]) if len(met) > 1 else out


def _summed(usable: DataFrame, spots: DataFrame, streams: dict[str, tuple[Column, Column]], terms: dict[str, list[tuple[int, str, Column]]]) -> DataFrame:
    """(chrom, low, high, bam, terms) of simple reads at narrow places, from numbers of reads up to positions: a place looks some of them up, and meets no read.

    streams: which reads count, and at which position. terms: signs, streams, and positions up to which they are taken."""
    # Streams that count at the same position of a read are one row.
    spots_of: dict[str, tuple[Column, dict[str, Column]]] = {}
    for name, (test, at) in streams.items():
        spots_of.setdefault(str(at), (at, {}))[1][name] = test
    told = lambda tests, n: F.when(tests[n], 1).otherwise(0) if n in tests else F.lit(0)
    every = F.array(*[F.when(reduce(lambda x, y: x | y, tests.values()), F.struct(at.alias("at"), *[told(tests, n).alias(n) for n in streams])) for at, tests in spots_of.values()])
    steps = usable.where("simple").select("chrom", "bam", F.explode(F.array_compact(every)).alias("e")).select("chrom", "bam", "e.*").groupBy("chrom", "bam", "at").agg(*[F.sum(n).alias(n) for n in streams])
    steps = written(steps)
    flat = [(t, sign, name, at) for t, parts in terms.items() for sign, name, at in parts]
    asked = spots.where("narrow").select("chrom", "low", "high", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), at.cast("long").alias("at")) for i, (_, _, _, at) in enumerate(flat)])).alias("x")).select("chrom", "low", "high", "x.i", "x.at")
    # Each file's own numbers at each position that is asked for; files are few.
    marks = asked.select("chrom", "at").distinct().join(steps.select("chrom", "bam").distinct(), "chrom").select("chrom", "bam", "at", *[F.lit(0).cast("long").alias(n) for n in streams], F.lit(1).cast("long").alias("asked"))
    total = running(steps.withColumn("asked", F.lit(0).cast("long")).unionByName(marks), ["chrom", "bam"], "at", list(streams))
    value = F.coalesce(*[F.when(F.col("i") == i, sign * F.col(name)) for i, (_, sign, name, _) in enumerate(flat)])
    # No broadcast, here and where sites meet: a table of sites takes far fewer bytes than what is asked for them, by which Spark would choose.
    found = asked.hint("merge").join(total, ["chrom", "at"]).select("chrom", "low", "high", "bam", "i", value.alias("v"))
    return found.groupBy("chrom", "low", "high", "bam").agg(*[F.sum(F.when(F.col("i").isin([i for i, f in enumerate(flat) if f[0] == t]), F.col("v")).otherwise(0)).alias(t) for t in terms])


def _streams(clip: int = 0) -> dict[str, tuple[Column, Column]]:
    pos, end, plain = F.col("pos"), F.col("ref_end"), F.col("plain")
    return {"begun": (F.lit(True), pos + 1), "ended": (F.lit(True), end), "plain_begun": (plain, pos + 1), "plain_ended": (plain, end), "left_at": (F.col("left") > clip, pos), "right_at": (F.col("right") > clip, end)}


def _overlapping(pad: int) -> list[tuple[int, str, Column]]:
    """Reads that begin before the end of a place with its pad, less those that end before it."""
    return [(1, "begun", F.col("high") + pad + 1), (-1, "ended", F.greatest(F.col("low") - pad, F.lit(0)))]


def _at_sites(sites: DataFrame, parts: list[DataFrame], names: list[str]) -> DataFrame:
    """(site, bam, near, names) of the sums of parts(chrom, low, high, bam, near, names) at sites, where any read is near."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    found = whole.groupBy("chrom", "low", "high", "bam").agg(*[F.sum(n).alias(n) for n in ("near", *names)]).where("near > 0")
    placed = sites.select("site", F.col("site_chrom").alias("chrom"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    return placed.hint("merge").join(found, ["chrom", "low", "high"]).groupBy("site", "bam").agg(*[F.sum(n).alias(n) for n in ("near", *names)])


def break_counts(reads: DataFrame, sites: DataFrame, pad: int = 5, flex: int = 1, least_mapq: int = 10, width: int = 1024) -> DataFrame:
    """(site, bam, alt, ref, vaf) of sites(site, site_chrom, low, high): a read that is clipped by more than the larger of
    the two positions' distance and pad counts as alt if it breaks within flex (less than pad) of either; an unclipped one as ref if it
    strictly spans both. Reads are counted by position, and sites look numbers up (see `_summed`), so depth costs nothing and reads don't meet sites."""
    if not 0 <= flex < pad:
        raise ValueError("flex must be less than pad")
    usable, spots = _usable(reads, least_mapq), cut(_spots(sites, pad))
    long = F.greatest(F.col("high") - F.col("low"), F.lit(pad))
    at = lambda p: (F.abs(p - F.col("low")) <= flex) | (F.abs(p - F.col("high")) <= flex)
    alt = ((F.col("right") > long) & at(F.col("ref_end"))) | ((F.col("left") > long) & at(F.col("pos")))
    ref = ~alt & F.col("plain") & (F.col("pos") < F.col("low")) & (F.col("ref_end") > F.col("high"))
    pairs = _paired(usable, spots, pad, width).groupBy("chrom", "low", "high", "bam").agg(F.count(F.lit(1)).alias("near"), F.count_if(alt).alias("alt"), F.count_if(ref).alias("ref"))
    sums = _summed(usable, spots, {n: s for n, s in _streams().items() if not n.endswith("_at")}, {"near": _overlapping(pad), "ref": [(1, "plain_begun", F.col("low")), (-1, "plain_ended", F.col("high"))]})
    # Breaks by place and bases clipped: a place meets one row for each of them.
    kinds = F.array_compact(F.array(F.when(F.col("left") > pad, F.struct(F.col("pos").alias("at"), F.col("left").alias("clip"))), F.when(F.col("right") > pad, F.struct(F.col("ref_end").alias("at"), F.col("right").alias("clip")))))
    breaks = usable.where("simple").select("chrom", "bam", F.explode(kinds).alias("e")).groupBy("chrom", "bam", "e.at", "e.clip").agg(F.count(F.lit(1)).alias("k"))
    beside = F.array_distinct(F.concat(*[F.sequence(F.col(c) - flex, F.col(c) + flex) for c in ("low", "high")]))
    asked = spots.where("narrow").select("chrom", "low", "high", F.explode(beside).alias("at"))
    hits = asked.hint("merge").join(breaks, ["chrom", "at"]).where(F.col("clip") > long).groupBy("chrom", "low", "high", "bam").agg(F.sum("k").alias("alt"))
    zero = lambda n: F.lit(0).cast("long").alias(n)
    met = _at_sites(sites, [pairs, sums.select("*", zero("alt")), hits.select("*", zero("near"), zero("ref"))], ["alt", "ref"])
    return met.select("site", "bam", "alt", "ref").withColumn("vaf", F.coalesce(F.try_divide(F.col("alt").cast("double"), F.col("alt") + F.col("ref")), F.lit(0.0)))


def genotype_lists(counts: DataFrame) -> DataFrame:
    """(site, genotypes, max_vaf): `bam|alt|ref|vaf` of each file, sorted and joined by commas."""
    entry = F.concat_ws("|", "bam", F.col("alt").cast("string"), F.col("ref").cast("string"), F.format_string("%.3f", "vaf"))
    return counts.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("genotypes"), F.max("vaf").alias("max_vaf"))


def endpoint_counts(reads: DataFrame, sites: DataFrame, clip: int = 5, width: int = 1024) -> DataFrame:
    """(site, n): reads clipped by more than `clip` whose alignment begins or ends within one base of the site's low position."""
    usable, spots = _usable(reads, 0).withColumn("bam", F.lit("")), cut(_spots(sites, 5))
    hit = ((F.col("left") > clip) & (F.abs(F.col("pos") - F.col("low")) <= 1)) | ((F.col("right") > clip) & (F.abs(F.col("ref_end") - F.col("low")) <= 1))
    pairs = _paired(usable, spots, 5, width).groupBy("chrom", "low", "high", "bam").agg(F.count(F.lit(1)).alias("near"), F.count_if(hit).alias("n"))
    low = F.col("low")
    n = [(sign, stream, low + at) for stream in ("left_at", "right_at") for sign, at in ((1, 1), (-1, -2))]
    sums = _summed(usable, spots, {k: s for k, s in _streams(clip).items() if not k.startswith("plain")}, {"near": _overlapping(5), "n": n})
    return _at_sites(sites, [pairs, sums], ["n"]).groupBy("site").agg(F.sum("n").alias("n"))


def junction_modes(reads: DataFrame, sites: DataFrame, window: int = 200, least: int = 4, share: float = 0.5, block: int = 1 << 13) -> DataFrame:
    """(site, junction, n) of every site: the commonest clipped end within window of its low position (smallest on ties) if
    there are `least` ends and it has that share, else the position itself. Ends are counted by position, and the counts around each place are a range window
    over them, so neither depth nor the number of sites makes pairs."""
    usable = _usable(reads, 10).where("ref_end > 0")
    # At the window's first position only reads that go on behind it overlap it.
    left, right = F.struct(F.col("pos").alias("p"), (F.col("ref_end") > F.col("pos")).alias("goes_on")), F.struct(F.col("ref_end").alias("p"), F.lit(False).alias("goes_on"))
    ends = usable.select("chrom", F.explode(F.array_compact(F.array(F.when(F.col("left") > 0, left), F.when(F.col("right") > 0, right)))).alias("e")).groupBy("chrom", "e.p").agg(F.count(F.lit(1)).alias("k"), F.count_if("e.goes_on").alias("k_on"))
    ends = written(ends)
    places = sites.select(F.col("site_chrom").alias("chrom"), F.col("low").cast("long").alias("p")).distinct()
    seats = F.explode(F.sequence(F.floor((F.col("p") - window) / block), F.floor((F.col("p") + window) / block)))
    both = ends.select("chrom", "p", "k", F.lit(False).alias("asked"), seats.alias("b")).unionByName(places.select("chrom", "p", F.lit(None).cast("long").alias("k"), F.lit(True).alias("asked"), F.floor(F.col("p") / block).alias("b")))
    around = W.partitionBy("chrom", "b").orderBy("p").rangeBetween(1 - window, window)
    top = both.withColumns({"n": F.sum("k").over(around), "t": F.min(F.when(F.col("k").isNotNull(), F.struct((-F.col("k")).alias("m"), "p"))).over(around)}).where("asked").select("chrom", F.col("p").alias("low"), "n", "t")
    first = ends.where("k_on > 0").select("chrom", (F.col("p") + window).alias("low"), F.col("k_on").alias("n"), F.struct((-F.col("k_on")).alias("m"), "p").alias("t"))
    found = top.unionByName(first.join(places.select("chrom", F.col("p").alias("low")).hint("merge"), ["chrom", "low"], "left_semi")).groupBy("chrom", "low").agg(F.sum("n").alias("n"), F.min("t").alias("t"))
    placed = sites.select("site", F.col("site_chrom").alias("chrom"), F.col("low").alias("low")).join(found.hint("merge"), ["chrom", "low"], "left")
    sure = (F.col("n") >= least) & (-F.col("t.m") >= share * F.col("n"))
    return placed.select("site", F.when(sure, F.col("t.p")).otherwise(F.col("low")).alias("junction"), F.coalesce("n", F.lit(0)).alias("n"))


def junction_supports(reads: DataFrame, sites: DataFrame, sides: tuple[str, ...] = ("left", "right"), margin: int = 5, least_mapq: int = 10, width: int = 1024) -> DataFrame:
    """(site, bam, alt_left, alt_right, ref), of the sides that are named: unclipped reads that strictly span low - margin and high + margin are ref; others
    with a soft clip on a side, within margin and the site's length of its break, are its alt. Reads are looked through once for both."""
    usable, spots = _usable(reads, least_mapq), cut(_spots(sites, margin))
    low, high, size = F.col("low"), F.col("high"), F.col("high") - F.col("low")
    ref = F.col("plain") & (F.col("pos") < low - margin) & (F.col("ref_end") > high + margin)
    edge = {"left": F.col("pos"), "right": F.col("ref_end")}
    alt = {side: ~ref & (F.col(side) > 0) & (F.abs(edge[side] - low) <= margin + size) for side in sides}
    pairs = _paired(usable, spots, margin, width).groupBy("chrom", "low", "high", "bam").agg(F.count(F.lit(1)).alias("near"), *[F.count_if(test).alias(f"alt_{side}") for side, test in alt.items()], F.count_if(ref).alias("ref"))
    # A long read that ends behind a place's begin can lie before it with its left break, not with its right one.
    begin = {"left": low - margin - size - 1, "right": F.greatest(low - margin, F.lit(0))}
    terms = {f"alt_{side}": [(1, f"{side}_at", high + margin), (-1, f"{side}_at", begin[side])] for side in sides}
    streams = {k: s for k, s in _streams().items() if k.removesuffix("_at") in sides or not k.endswith("_at")}
    sums = _summed(usable, spots, streams, {"near": _overlapping(margin), **terms, "ref": [(1, "plain_begun", low - margin), (-1, "plain_ended", high + margin)]})
    return _at_sites(sites, [pairs, sums], [*terms, "ref"]).select("site", "bam", *terms, "ref")


def junction_support(reads: DataFrame, sites: DataFrame, side: str, margin: int = 5, least_mapq: int = 10, width: int = 1024) -> DataFrame:
    """(site, bam, alt, ref): junction_supports of one side."""
    return junction_supports(reads, sites, (side,), margin, least_mapq, width).withColumnRenamed(f"alt_{side}", "alt")


def reference_vaf(left: DataFrame, right: DataFrame) -> DataFrame:
    """(site, vafs): of junction_support on both sides, `bam|vaf` sorted and joined by commas; 0 without reads."""
    both = left.unionByName(right).groupBy("site", "bam").agg(F.sum("alt").alias("a"), F.sum(F.col("alt") + F.col("ref")).alias("t"))
    entry = F.concat_ws("|", "bam", F.format_string("%.3f", F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("t")), F.lit(0.0))))
    return both.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("vafs"))
