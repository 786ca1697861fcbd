"""Assembly of reads: words that overlap are a graph, and its unbranched paths are contracted by pointer doubling.

Words and pointers are tables. A round joins each word to what its pointer points to, so a path of n words takes log2(n) rounds and
no cluster, however deep, comes into one task. A contig is one row in the end, as it is one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import reverse_complement
from .consensus import local_alignment
from .lineage import cut, written
from .names import free


def words(reads: DataFrame, keys: list[str], k: int, least: int = 1, seq: str = "seq") -> DataFrame:
    """(keys, word, n): words of k letters ACGT of each group's reads, of a word and its reverse complement the lesser, that occur `least` times or
    more. Null and shorter sequences have none; each occurrence counts, also within one read."""
    up = F.upper(F.col(seq))
    each = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(up, i, F.lit(k)))
    (word,) = free(reads, "word")
    rows = reads.where(F.length(seq) >= k).select(*keys, F.explode(each).alias(word)).where(~F.col(word).rlike("[^ACGT]"))
    counted = rows.select(*keys, F.least(F.col(word), reverse_complement(F.col(word))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _links(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, a, b): oriented words of which b alone follows a, and a alone stands before b."""
    both = nodes.select(*keys, F.explode(F.array("word", reverse_complement(F.col("word")))).alias("w"))
    tail, head = F.substring("w", 2, k - 1), F.substring("w", 1, k - 1)
    # At most four words begin, or end, with the same k - 1 letters, so counting them first bounds the join.
    out = both.groupBy(*keys, tail.alias("joint")).agg(F.count(F.lit(1)).alias("n_a"), F.min("w").alias("a"))
    into = both.groupBy(*keys, head.alias("joint")).agg(F.count(F.lit(1)).alias("n_b"), F.min("w").alias("b"))
    return out.where("n_a = 1").join(into.where("n_b = 1"), [*keys, "joint"]).select(*keys, "a", "b")


def unitigs(counted: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, contig, n_words, mean_count) of words(keys, word, n): maximal paths on which each word has one follower, whose one predecessor it is.
    A path and its reverse complement are one contig, the lesser text; a circle begins at its least word. k is odd, so that no word is
    its own reverse; a word without neighbours is a contig. An empty table has none.
    """
    if not k % 2:
        raise ValueError("words of an even length can be their own reverse")
    counted = cut(counted)
    nodes = counted.select(*keys, F.explode(F.array("word", reverse_complement(F.col("word")))).alias("w"), "n")
    links = _links(counted, keys, k)
    # A hairpin, where a path turns into its own reverse, is no link within a path.
    links = links.where(F.col("b") != reverse_complement(F.col("a")))
    # at: the word that the pointer has come to, seen from w backwards; least: the least word, either way round, from w back to there, without it.
    now = written(nodes.join(links.withColumnRenamed("b", "w"), [*keys, "w"], "left").select(*keys, "w", "n", F.col("a").alias("at"), F.when(F.col("a").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.least(F.col("w"), reverse_complement(F.col("w"))).alias("least")))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(*keys, F.col("w").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        # A word that has come to the head of its path stays there; the head's own pointer is null.
        goes = F.col("at2").isNotNull()
        moved = now.drop("went").join(ahead, [*keys, "at"], "left")
        now = written(moved.select(*keys, "w", "n", F.when(goes, F.col("at2")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(goes, F.col("steps2")).otherwise(0)).alias("steps"), F.when(goes, F.least("least", "least2")).otherwise(F.col("least")).alias("least"), goes.alias("went")))
        if now.where("went").isEmpty():
            break
    heads = now.where(F.col("at").isNull()).select(*keys, F.col("w").alias("at"), F.lit(True).alias("is_head"))
    told = now.join(heads, [*keys, "at"], "left")
    straight = told.where(F.col("at").isNull() | F.col("is_head")).select(*keys, F.coalesce("at", "w").alias("head"), "w", "n", "steps")
    # What is left are circles: after more steps than there are words, `least` is that of the whole circle, where it is cut open. Of a
    # circle and its reverse only one holds that word the way it reads.
    circles = told.where(F.col("at").isNotNull() & F.col("is_head").isNull()).select(*keys, "w", "n", F.col("least").alias("head"))
    opened = _ranked(circles, links, keys)
    paths = straight.unionByName(opened)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("steps", F.right("w", F.lit(1)).alias("letter")))), lambda s: s["letter"]), "")
    sized = paths.groupBy(*keys, "head").agg(letters.alias("letters"), F.count(F.lit(1)).alias("n_words"), F.avg("n").alias("mean_count"))
    contig = sized.select(*keys, F.concat(F.substring("head", 1, k - 1), "letters").alias("contig"), "n_words", "mean_count")
    turned = contig.withColumn("contig", F.least(F.col("contig"), reverse_complement(F.col("contig"))))
    return turned.dropDuplicates([*keys, "contig"])


def _ranked(circles: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head, w, n, steps) of circles(keys, w, n, head): how far each word lies behind its circle's head, by doubling as before."""
    circles = written(circles)
    if circles.isEmpty():
        return circles.select(*keys, "head", "w", "n", F.lit(0).cast("long").alias("steps"))
    back = circles.join(links.withColumnRenamed("b", "w"), [*keys, "w"])
    now = written(back.select(*keys, "head", "w", "n", F.when(F.col("w") != F.col("head"), F.col("a")).alias("at"), F.when(F.col("w") != F.col("head"), 1).otherwise(0).cast("long").alias("steps")))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(*keys, F.col("w").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"))
        moved = now.join(ahead, [*keys, "at"], "left")
        goes = F.col("at2").isNotNull()
        now = written(moved.select(*keys, "head", "w", "n", F.when(goes, F.col("at2")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(goes, F.col("steps2")).otherwise(0)).alias("steps")))
    return now.where(F.coalesce("at", "w") == F.col("head")).select(*keys, "head", "w", "n", "steps")


def assembled(reads: DataFrame, keys: list[str], k: int = 31, abundances: tuple[int, ...] = (1, 2), seq: str = "seq") -> DataFrame:
    """(keys, abundance, contig, n_words, mean_count): the contigs of each group's reads, once for each least number of occurrences of a word."""
    counted = cut(words(reads, keys, k, min(abundances), seq))
    out = None
    for least in abundances:
        one = unitigs(counted.where(F.col("n") >= least), keys, k).withColumn("abundance", F.lit(least))
        out = one if out is None else out.unionByName(one)
    return out.select(*keys, "abundance", "contig", "n_words", "mean_count")


#: Equal columns' share of an alignment that joins, more than this; its least columns; and how near an end it must come.
JOIN_SCORE, JOIN_COLUMNS, JOIN_END = 0.95, 20, 2


def joined_text(one: str | None, two: str | None) -> tuple[str | None, float, int]:
    """(joined, share of equal columns, columns) of two sequences of which the first ends, or the second begins, with what they share."""
    hit = local_alignment(one, two) if one and two else None
    if hit is None:
        return None, 0.0, 0
    _, _, end, start, stop, same, columns = hit
    share = same / columns
    fits = share > JOIN_SCORE and columns >= JOIN_COLUMNS and (end > len(one) - JOIN_END + 1 or start < JOIN_END)
    return (one + two[stop:] if fits else None), share, columns


def rescued(contigs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contig, is_joined): contigs, and for each group with two or more the sequence that joins its two longest (of equal length the lesser), if one of
    the two orders joins; if both do, that with the greater share of equal columns times columns, the second if they are equal."""
    longest = contigs.groupBy(*keys).agg(F.min(F.struct((-F.length("contig")).alias("n"), "contig")).alias("one"))
    met = contigs.join(longest, keys)
    second = met.where(F.struct((-F.length("contig")).alias("n"), "contig") > F.col("one")).groupBy(*keys, "one").agg(F.min(F.struct((-F.length("contig")).alias("n"), "contig")).alias("two"))

    def run(frames):
        for pdf in frames:
            out = []
            for one, two in zip(pdf["one"], pdf["two"]):
                (a, share_a, n_a), (b, share_b, n_b) = joined_text(one, two), joined_text(two, one)
                out.append(a if b is None or (a is not None and share_a * n_a > share_b * n_b) else b)
            yield pdf[keys].assign(contig=out)

    schema = T.StructType([*[contigs.schema[key] for key in keys], T.StructField("contig", T.StringType())])
    pairs = second.select(*keys, F.col("one.contig").alias("one"), F.col("two.contig").alias("two"))
    new = pairs.mapInPandas(run, schema).where(F.col("contig").isNotNull()).withColumn("is_joined", F.lit(True))
    return contigs.select(*keys, "contig").withColumn("is_joined", F.lit(False)).unionByName(new)


def gc(s: Column) -> Column:
    """The share of G and C among the letters ACGT; null if there are none."""
    known = F.length(F.regexp_replace(F.upper(s), "[^ACGT]", ""))
    return F.try_divide(F.length(F.regexp_replace(F.upper(s), "[^GC]", "")).cast("double"), known)
