"""The queries over the driver's tables, each with the SQL that gives the same rows.

A customer's nation, a supplier or a user stands for a chromosome, days or seconds for positions, rows for reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.operators import clusters as cl
from strandloom.operators import evidence as ev
from strandloom.operators import intervals as iv
from strandloom.operators import pairing
from strandloom.sources.genomic import fasta_records
from strandloom.streaming.sessions import session_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        name = f.__name__[0].upper() + f.__name__[1:]
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", _seconds("ts").alias("s"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as intervals on their customer's nation."""
    nation = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("chrom"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("start"))
    return orders.join(nation, "o_custkey").select("o_orderkey", "chrom", "start", (F.col("start") + 3).alias("end"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Labelled and scored intervals on the same axis, one for each customer."""
    start = (F.lit(9131) + (F.col("c_custkey") * 37) % 2400).alias("b_start")
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("b_chrom"), start, (F.lit(9131 + 5) + (F.col("c_custkey") * 37) % 2400 + F.col("c_custkey") % 20).alias("b_end"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("score"), "c_custkey")


_E = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"
_A = "SELECT o_orderkey, c_nationkey AS chrom, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS st, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3 AS en FROM orders JOIN customer ON o_custkey = c_custkey"
_B = "SELECT c_custkey, c_nationkey AS b_chrom, 9131 + (c_custkey * 37) % 2400 AS b_st, 9136 + (c_custkey * 37) % 2400 + c_custkey % 20 AS b_en, c_mktsegment AS label, c_acctbal AS score FROM customer"
_MEET = "chrom = b_chrom AND st < b_en AND en > b_st"
BIN, DAY = 16, 86400


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS price, CASE WHEN l_returnflag = 'R' THEN 'alt' ELSE 'ref' END AS allele FROM lineitem")
def q01_scan_project(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("price"), F.when(F.col("l_returnflag") == "R", "alt").otherwise("ref").alias("allele"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND least(l_discount, l_tax) <= 0.02 AND l_returnflag <> 'N' AND l_extendedprice >= 2000")
def q02_clip_filter(spark, d):
    return _t(spark, d, "lineitem").where((F.col("l_quantity") >= 10) & (F.least("l_discount", "l_tax") <= 0.02) & (F.col("l_returnflag") != "N") & (F.col("l_extendedprice") >= 2000)).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, CASE WHEN l_discount < l_tax THEN 'right' ELSE 'left' END AS side, CASE WHEN l_discount < l_tax THEN l_partkey - 1 ELSE l_suppkey END AS breakpos FROM lineitem")
def q03_strand_projection(spark, d):
    right = F.col("l_discount") < F.col("l_tax")
    return _t(spark, d, "lineitem").select("l_orderkey", F.when(right, "right").otherwise("left").alias("side"), F.when(right, F.col("l_partkey") - 1).otherwise(F.col("l_suppkey")).alias("breakpos"))


_CHAIN = f"e AS ({_E}), c AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 21600 THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM c)"


@query(f"WITH {_CHAIN} SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS n FROM k GROUP BY user_id, chain HAVING count(*) >= 4")
def q04_gap_cluster(spark, d):
    chained = cl.gap_chain(_events(spark, d), "user_id", "s", "s", 6 * 3600, "event_id")
    return chained.groupBy("user_id", "chain").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 4").drop("chain")


@query(f"WITH {_CHAIN}, t AS (SELECT user_id, chain, event_type, count(*) AS n, min(s) AS first FROM k GROUP BY ALL HAVING count(*) >= 2), l AS (SELECT user_id, chain, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels FROM k GROUP BY ALL) SELECT user_id, event_type, n, first, labels FROM t JOIN l USING (user_id, chain)")
def q05_label_subcluster(spark, d):
    chained = cl.gap_chain(_events(spark, d), "user_id", "s", "s", 6 * 3600, "event_id")
    typed = chained.groupBy("user_id", "chain", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"))
    labels = chained.groupBy("user_id", "chain").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("labels"))
    return typed.where("n >= 2").join(labels, ["user_id", "chain"]).select("user_id", "event_type", "n", "first", "labels")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM ({_E})),
f AS (SELECT user_id, rn, s, [s] AS l, 1 AS cid FROM e WHERE rn = 1 UNION ALL
SELECT e.user_id, e.rn, e.s, CASE WHEN abs(f.l[len(f.l) // 2 + 1] - e.s) > 36000 THEN [e.s] ELSE list_append(f.l, e.s) END, CASE WHEN abs(f.l[len(f.l) // 2 + 1] - e.s) > 36000 THEN cid + 1 ELSE cid END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, min(s) AS first, max(s) AS last, count(*) AS n FROM f GROUP BY user_id, cid""")
def q06_median_cluster(spark, d):
    return cl.median_cluster(_events(spark, d), "user_id", "s", 36000)


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS alt, count(*) FILTER (l_returnflag <> 'R') AS ref, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 6) AS vaf FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4 AND count(*) FILTER (l_returnflag = 'R') >= 1")
def q07_breakend_vaf(spark, d):
    counted = ev.allele_counts(_t(spark, d, "lineitem").where(F.col("l_returnflag").isNotNull()), ["l_orderkey"], F.col("l_returnflag") == "R")
    return counted.where((F.col("alt") + F.col("ref") >= 4) & (F.col("alt") >= 1)).withColumn("vaf", F.round("vaf", 6))


@query(f"SELECT o_orderkey, c_custkey, least(en, b_en) - greatest(st, b_st) AS bases FROM ({_A}) JOIN ({_B}) ON {_MEET}")
def q08_overlap_join(spark, d):
    met = iv.overlap_pairs(_spans(spark, d), _targets(spark, d).drop("label", "score"), BIN)
    return met.select("o_orderkey", "c_custkey", sq.overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")).alias("bases"))


@query(f"SELECT o_orderkey, chrom, st AS start FROM ({_A}) WHERE EXISTS (SELECT 1 FROM ({_B}) WHERE {_MEET})")
def q09_overlap_semi(spark, d):
    return iv.overlap_semi(_spans(spark, d), _targets(spark, d), BIN).select("o_orderkey", "chrom", "start")


@query(f"SELECT o_orderkey, chrom, st AS start FROM ({_A}) WHERE NOT EXISTS (SELECT 1 FROM ({_B}) WHERE {_MEET})")
def q10_overlap_anti(spark, d):
    return iv.overlap_anti(_spans(spark, d), _targets(spark, d), BIN).select("o_orderkey", "chrom", "start")


@query(f"SELECT o_orderkey, b_st AS b_start, b_en AS b_end, label FROM ({_A}) JOIN ({_B}) ON {_MEET} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY b_st, b_en, label) = 1")
def q11_first_overlap(spark, d):
    return iv.first_overlap(_spans(spark, d), _targets(spark, d), ["o_orderkey"], BIN)


@query(f"WITH m AS (SELECT o_orderkey, greatest(0, least(b_en, en) - greatest(b_st + 1, st) + 1) AS k, score FROM ({_A}) JOIN ({_B}) ON {_MEET}), x AS (SELECT o_orderkey, sum(k * score) / nullif(sum(k), 0) AS v FROM m GROUP BY 1) SELECT o_orderkey, round(coalesce(v, 0), 4) AS mean_score FROM ({_A}) LEFT JOIN x USING (o_orderkey)")
def q12_weighted_overlap(spark, d):
    return iv.weighted_mean(_spans(spark, d), _targets(spark, d), ["o_orderkey"], BIN).withColumn("mean_score", F.round("mean_score", 4))


@query(f"WITH m AS (SELECT o_orderkey, string_agg(DISTINCT label, ';' ORDER BY label) AS a FROM ({_A}) JOIN ({_B}) ON {_MEET} GROUP BY 1) SELECT o_orderkey, coalesce(a, 'NA') AS annotation FROM ({_A}) LEFT JOIN m USING (o_orderkey)")
def q13_annotate(spark, d):
    return iv.annotate(_spans(spark, d), _targets(spark, d), ["o_orderkey"], BIN).select("o_orderkey", "annotation")


_BAND = f"SELECT a.event_id AS left_id, b.event_id AS right_id, a.user_id, a.s AS ls, b.s AS rs, a.value AS lv, b.value AS rv FROM ({_E}) a JOIN ({_E}) b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(a.s - b.s) <= 7200"


def _band(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'click'").select(F.col("user_id").alias("chrom"), F.col("s").alias("pos"), F.col("event_id").alias("left_id"), F.col("value").alias("lv"))
    right = e.where("event_type = 'view'").select(F.col("user_id").alias("r_chrom"), F.col("s").alias("r_pos"), F.col("event_id").alias("right_id"), F.col("value").alias("rv"))
    return iv.band_pairs(left, right, 7200)


@query(f"SELECT left_id, right_id, user_id, abs(ls - rs) AS apart FROM ({_BAND})")
def q14_band_pairs(spark, d):
    return _band(spark, d).select("left_id", "right_id", F.col("chrom").alias("user_id"), F.abs(F.col("pos") - F.col("r_pos")).alias("apart"))


_SCORE = "round(pow(ov, 1.5) * exp(-ov / 3.0) / (1.3293403881791370::DOUBLE * pow(3.0::DOUBLE, 2.5)) * ov * ov - CASE WHEN ov > 0 THEN abs(abs(ls - rs)::DOUBLE - ov) ELSE abs(ls - rs)::DOUBLE END + lv + rv, 4)"


def _scored(spark, d):
    band = _band(spark, d).withColumn("ov", (F.abs(F.col("pos") - F.col("r_pos")) % 20).cast("double"))
    return band.select(F.col("chrom").alias("user_id"), "left_id", "right_id", F.round(sq.pair_score(F.col("pos"), F.col("r_pos"), F.col("ov"), F.col("lv"), F.col("rv")), 4).alias("score"))


@query(f"SELECT user_id, left_id, right_id, {_SCORE} AS score FROM (SELECT *, (abs(ls - rs) % 20)::DOUBLE AS ov FROM ({_BAND}))")
def q15_pair_score(spark, d):
    return _scored(spark, d)


@query()
def q16_greedy_pairs(spark, d):
    # No pair crosses a gap of more than 7200 seconds in a user's clicks and views.
    e = _events(spark, d).where("event_type in ('click', 'view')")
    chains = cl.gap_chain(e, "user_id", "s", "s", 7200, "event_id").where("event_type = 'click'").select(F.col("event_id").alias("left_id"), "chain")
    return pairing.greedy_pairs(_scored(spark, d).join(chains, "left_id"), ["user_id", "chain"], "left_id", "right_id", "score").drop("chain")


@query("SELECT a.l_orderkey, a.l_partkey AS part, b.l_partkey AS mate_part, a.l_shipdate = b.l_shipdate AS together FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_suppkey <> b.l_suppkey")
def q17_mate_join(spark, d):
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    mate = l.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("mate_part"), F.col("l_suppkey").alias("ms"), F.col("l_shipdate").alias("md"))
    return l.where("l_linenumber = 1").join(mate, "l_orderkey").where("l_suppkey <> ms").select("l_orderkey", F.col("l_partkey").alias("part"), "mate_part", (F.col("l_shipdate") == F.col("md")).alias("together"))


@query(f"WITH e AS ({_E}) SELECT event_id, user_id, value FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND abs(o.s - e.s) <= 3600 AND o.value > e.value)")
def q18_decluster(spark, d):
    e = _events(spark, d).select("event_id", F.col("user_id").alias("chrom"), F.col("s").alias("pos"), "value")
    return iv.decluster(e, "value", 3600).select("event_id", F.col("chrom").alias("user_id"), "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) = 1")
def q19_dedup_prefer(spark, d):
    return iv.prefer(_t(spark, d, "orders"), ["o_custkey"], [(F.col("o_orderstatus") == "F").desc(), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_RUNS = "SELECT s_suppkey % 7 AS chrom, 9131 + (s_suppkey * 53) % 900 AS st, 9131 + (s_suppkey * 53) % 900 + 10 + s_suppkey % 60 AS en, CAST(floor(s_acctbal / 100) AS BIGINT) AS size FROM supplier"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY st, en, size) AS rn FROM ({_RUNS})),
f AS (SELECT chrom, rn, st, en, size, CAST(NULL AS STRUCT(st BIGINT, en BIGINT, size BIGINT)) AS out FROM r WHERE rn = 1 UNION ALL
SELECT r.chrom, r.rn, CASE WHEN r.st < f.en AND r.en > f.st AND r.size <= f.size THEN f.st ELSE r.st END, CASE WHEN r.st < f.en AND r.en > f.st AND r.size <= f.size THEN f.en ELSE r.en END,
CASE WHEN r.st < f.en AND r.en > f.st AND r.size <= f.size THEN f.size ELSE r.size END, CASE WHEN r.st < f.en AND r.en > f.st THEN NULL ELSE {{'st': f.st, 'en': f.en, 'size': f.size}} END
FROM f JOIN r ON r.chrom = f.chrom AND r.rn = f.rn + 1)
SELECT chrom, out.st AS start, out.en AS end, out.size AS size FROM f WHERE out IS NOT NULL UNION ALL SELECT chrom, st, en, size FROM f QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY rn DESC) = 1""")
def q20_sweep_dedup(spark, d):
    s = _t(spark, d, "supplier")
    start = F.lit(9131) + (F.col("s_suppkey") * 53) % 900
    return cl.sweep_longest(s.select((F.col("s_suppkey") % 7).alias("chrom"), start.alias("start"), (start + 10 + F.col("s_suppkey") % 60).alias("end"), F.floor(F.col("s_acctbal") / 100).alias("size")), "chrom")


@query("""WITH dep AS (SELECT l_suppkey % 10 AS chrom, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS pos, count(*) AS depth FROM lineitem GROUP BY ALL),
m AS (SELECT *, CASE WHEN pos = lag(pos) OVER (PARTITION BY chrom ORDER BY pos) + 1 AND depth > 2 THEN 0 ELSE 1 END AS nw FROM dep),
i AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT chrom, min(pos) AS start, max(pos) + 1 AS end FROM i GROUP BY chrom, g HAVING max(pos) - min(pos) >= 2""")
def q21_covered_segments(spark, d):
    depth = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("chrom"), _day("l_shipdate").alias("pos")).agg(F.count(F.lit(1)).alias("depth"))
    return cl.islands(depth, "chrom", "pos", "depth", 2, 2)


@query(f"WITH w AS (SELECT user_id, s, (row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1) // 10 AS w FROM ({_E})) SELECT user_id, w AS window, min(s) AS first, max(s) AS last, count(*) AS n FROM w GROUP BY ALL")
def q22_even_windows(spark, d):
    return cl.even_windows(_events(spark, d), "user_id", ["s", "event_id"], 10).groupBy("user_id", "window").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS n FROM supplier) SELECT s_suppkey, st AS start, least(st + 1000, n) AS end FROM c, LATERAL (SELECT unnest(range(0, n, 1000)) AS st) WHERE n > 0")
def q23_genome_bins(spark, d):
    return cl.bins(_t(spark, d, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("n")), "s_suppkey", "n", 1000)


@query("""WITH c AS (SELECT s_suppkey, CAST(floor(greatest(s_acctbal, 0)) AS BIGINT) AS n FROM supplier), e AS (SELECT *, sum(n) OVER (ORDER BY s_suppkey) AS t FROM c), p AS (SELECT CAST(ceil(sum(n) / 24.0) AS BIGINT) AS w FROM c),
m AS (SELECT s_suppkey, t - n AS f, t, w, unnest(range(CAST(t - n AS BIGINT) // w, (CAST(t AS BIGINT) - 1) // w + 1)) AS k FROM e, p WHERE n > 0)
SELECT k AS chunk, s_suppkey, CAST(greatest(f, k * w) - f AS BIGINT) AS start, CAST(least(t, (k + 1) * w) - f AS BIGINT) AS end FROM m""")
def q24_chunks(spark, d):
    return cl.chunks(_t(spark, d, "supplier").select("s_suppkey", F.floor(F.greatest("s_acctbal", F.lit(0.0))).alias("n")), "s_suppkey", "n", 24)


@query(f"WITH c AS (SELECT event_type, s // {DAY} AS day, count(*) AS n FROM ({_E}) GROUP BY ALL), z AS (SELECT *, (n - avg(n) OVER ()) / nullif(stddev_pop(n) OVER (), 0) AS z FROM c) SELECT event_type, day, n, round(z, 6) AS z FROM z WHERE z > 1")
def q25_zscore_mask(spark, d):
    counts = _events(spark, d).groupBy("event_type", F.floor(F.col("s") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return ev.zscore_mask(counts, None, "n", 1.0).withColumn("z", F.round("z", 6))


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_suppkey) AS BIGINT) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM c) SELECT l_suppkey, l_returnflag, n, total FROM t WHERE r = 1 AND total >= 4 AND n >= 0.35 * total")
def q26_mode_threshold(spark, d):
    return ev.mode_with_share(_t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", 4, 0.35)


@query("WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_suppkey || '|' || n, ',' ORDER BY l_suppkey || '|' || n) AS samples, count(*) AS n_samples, max(n) AS max_samples FROM c GROUP BY 1")
def q27_counted_set(spark, d):
    return ev.counted_set(_t(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "samples")


_DOSE = "WITH c AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS alt, count(*) AS depth FROM lineitem GROUP BY 1), v AS (SELECT *, alt / depth::DOUBLE AS vaf FROM c)"


@query(f"{_DOSE} SELECT l_partkey, depth, round(CASE WHEN depth < 10 THEN 0 ELSE 2 - 2 * vaf END, 4) AS dose, CASE WHEN depth < 10 THEN './.' WHEN 2 - 2 * vaf > 0.3 AND 2 - 2 * vaf < 2 * (1 - 0.15::DOUBLE) THEN '0/1' WHEN 2 - 2 * vaf < 0.3 THEN '0/0' ELSE '1/1' END AS gt FROM v")
def q28_dosage(spark, d):
    c = ev.allele_counts(_t(spark, d, "lineitem"), ["l_partkey"], F.col("l_returnflag") == "R").withColumn("depth", F.col("alt") + F.col("ref"))
    return c.select("l_partkey", "depth", F.round(F.when(F.col("depth") < 10, 0.0).otherwise(sq.dose(F.col("vaf"))), 4).alias("dose"), sq.genotype(F.col("depth"), F.col("vaf")).alias("gt"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def q29_per_sample_pivot(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.select("l_suppkey", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in ("A", "N", "R")])


#: Reason codes and their conditions, as Spark reads them; DuckDB writes the double otherwise.
_TESTS = {"LowQuantity": "l_quantity < 5", "HighTax": "l_tax > 0.07D", "NoDiscount": "l_discount = 0", "Open": "l_linestatus = 'O'"}
_WS = ", ".join(f"CASE WHEN {s} THEN '{k}' END" for k, s in ((k, s.replace("0.07D", "0.07::DOUBLE")) for k, s in _TESTS.items()))


@query(f"SELECT l_orderkey, l_partkey, coalesce(nullif(concat_ws(',', {_WS}), ''), 'PASS') AS filter FROM lineitem")
def q30_reasons(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", ev.reasons({k: F.expr(c) for k, c in _TESTS.items()}).alias("filter"))


@query(f"SELECT coalesce({_WS}, 'none') AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def q31_first_reason(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.coalesce(ev.first_reason({k: F.expr(c) for k, c in _TESTS.items()}), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, CASE WHEN l_tax > l_discount THEN l_suppkey ELSE l_partkey END AS l_partkey, CASE WHEN l_tax > l_discount THEN l_partkey ELSE l_suppkey END AS l_suppkey FROM lineitem")
def q32_flip_ends(spark, d):
    return ev.swap_columns(_t(spark, d, "lineitem"), [("l_partkey", "l_suppkey")], F.col("l_tax") > F.col("l_discount")).select("l_orderkey", "l_partkey", "l_suppkey")


@query(f"SELECT p_partkey, reverse(translate(p_name, '{sq.CODES}', '{sq.COMPLEMENTS}')) AS rc FROM part")
def q33_revcomp(spark, d):
    return _t(spark, d, "part").select("p_partkey", sq.reverse_complement(F.col("p_name")).alias("rc"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def q34_levenshtein(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o")), "p_partkey").select("p_partkey", F.levenshtein("p_name", "o").cast("long").alias("distance"))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(upper(text), '(E+)', 1), lambda x: length(x))), 0) AS run FROM documents")
def q35_homopolymer(spark, d):
    return _t(spark, d, "documents").select("doc_id", sq.longest_run(F.col("text"), "E").cast("long").alias("run"))


@query("SELECT c_custkey, round(coalesce(greatest(length(m) - length(replace(m, 'A', '')), length(m) - length(replace(m, 'T', ''))) / nullif(length(m), 0)::DOUBLE, 0), 6) AS fraction FROM (SELECT c_custkey, upper(c_name || c_mktsegment) AS m FROM customer)")
def q36_poly_a_fraction(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.round(sq.poly_a_fraction(F.concat("c_name", "c_mktsegment")), 6).alias("fraction"))


@query("SELECT a.c_custkey, round(list_sum(list_transform(range(1, length(a.c_name) + 1), lambda i: CASE WHEN upper(a.c_name)[i] = upper(b.c_name)[i] THEN 1 ELSE 0 END)) / length(a.c_name)::DOUBLE, 6) AS matched FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def q37_match_fraction(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("o")), "c_custkey").select("c_custkey", F.round(sq.match_fraction(F.col("c_name"), F.col("o")), 6).alias("matched"))


@query("SELECT vec_id, coalesce(list_filter(range(0, len(embedding) - 4), lambda i: (embedding[i+1]::DOUBLE + embedding[i+2]::DOUBLE + embedding[i+3]::DOUBLE + embedding[i+4]::DOUBLE) / 4 < -0.05)[1], -1) AS trim_at FROM embeddings")
def q38_quality_trim(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.coalesce(sq.quality_trim_at(F.transform("embedding", lambda x: x.cast("double")), 4, -0.05), F.lit(-1)).cast("long").alias("trim_at"))


@query("SELECT doc_id, strpos(text, 'the') - 1 AS first_at, CASE WHEN strpos(reverse(text), 'eht') > 0 THEN length(text) - strpos(reverse(text), 'eht') - 2 ELSE -1 END AS last_at FROM documents")
def q39_locate(spark, d):
    t, s = F.col("text"), F.lit("the")
    return _t(spark, d, "documents").select("doc_id", F.coalesce(sq.locate_first(t, s)["start"], F.lit(-1)).cast("long").alias("first_at"), F.coalesce(sq.locate_last(t, s)["start"], F.lit(-1)).cast("long").alias("last_at"))


@query("SELECT l_partkey, max(l_extendedprice) AS score, arg_max(l_orderkey, {'p': l_extendedprice, 'o': l_orderkey}) AS best FROM lineitem WHERE l_discount < 0.05 GROUP BY 1")
def q40_top_hit(spark, d):
    return _t(spark, d, "lineitem").where("l_discount < 0.05D").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("score"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("best"))


@query("SELECT l_orderkey, l_partkey, greatest(l_partkey, l_suppkey * 15) - least(l_partkey + l_quantity::BIGINT, l_suppkey * 15 + 60) AS distance FROM lineitem")
def q41_interval_distance(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey") * 15
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", sq.signed_distance(p, p + F.col("l_quantity").cast("long"), s, s + 60).alias("distance"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def q42_cap_sample(spark, d):
    return ev.sample_cap(_t(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 4)")
def q43_density_guard(spark, d):
    return ev.depth_cap(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey"], 4)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q44_semi_ids(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").join(_t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q45_anti_ids(spark, d):
    return _t(spark, d, "orders").select("o_orderkey").join(_t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_totalprice > 100000) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def q46_union_merge(spark, d):
    o = _t(spark, d, "orders")
    return iv.prefer(o.where("o_orderstatus = 'F'").unionByName(o.where("o_totalprice > 100000")), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH e AS ({_E}), a AS (SELECT user_id, min(s) AS started FROM e WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, max(s) AS ended FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, coalesce(CAST(ended - started AS VARCHAR), 'UNFINISHED') AS took FROM a LEFT JOIN b USING (user_id)")
def q47_log_sessions(spark, d):
    e = _events(spark, d)
    started = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("s").alias("started"))
    ended = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("s").alias("ended"))
    return started.join(ended, "user_id", "left").select("user_id", F.coalesce((F.col("ended") - F.col("started")).cast("string"), F.lit("UNFINISHED")).alias("took"))


@query(r"SELECT doc_id, regexp_extract(split_part(text, chr(10), 1), '^([^ \t\n\x0B\f\r]*)', 1) AS seq_id, length(regexp_replace(regexp_replace(text, '^[^\n]*\n?', ''), '[ \t\n\x0B\f\r]', '', 'g')) AS size FROM documents")
def q48_fasta_parse(spark, d):
    return _t(spark, d, "documents").select("doc_id", fasta_records(F.col("text")).alias("r")).select("doc_id", "r.seq_id", F.length("r.seq").cast("long").alias("size"))


@query("""WITH r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS r FROM events)
SELECT user_id, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type <> 'click') AS n2, round(coalesce(sum(r) FILTER (event_type = 'click'), 0)::DOUBLE - count(*) FILTER (event_type = 'click') * (count(*) FILTER (event_type = 'click') + 1) / 2.0, 3) AS u FROM r GROUP BY 1""")
def q49_mann_whitney(spark, d):
    return ev.rank_sum(_t(spark, d, "events"), "user_id", "value", F.col("event_type") == "click").withColumn("u", F.round("u", 3))


@query("""WITH e AS (SELECT user_id, ts, event_id FROM events), c AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM k GROUP BY user_id, g""")
def q51_sessions(spark, d):
    s = session_counts(_t(spark, d, "events"), "6 hours")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


from . import format_queries, genome_queries, read_queries  # noqa: E402, F401  (register the queries on reads and calls, on lines of other tools, and on genomes)
