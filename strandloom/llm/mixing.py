"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token counts of the cells are raked until their sums meet the
target share of each source, language and topic; a cell's raked weight over its tokens is its documents' rate. Rates
are scaled, with probabilities held at 1 at most, so that the expected tokens are the budget, and each document is kept
if a number drawn from its own hash is below its probability: the same documents at any partitioning.

Cells are aggregated before they meet. Up to MAX_CELLS of them (measured) are raked in the driver; more are raked as
a table, one dimension after the other, cut by checkpoints, until the same tolerance. Documents are never shuffled for a
bounded table of cells. Topics and tokens are counted once: documents are written with them to the shared folder.

Defined cases: a null source or language is a value of its own; a text without words has no token and is kept at its
cell's probability; equal doc_ids with equal texts share their fate; targets for values that don't occur are ignored
and the rest scaled; values without a target (null, or any not named) share what all targets leave, by their tokens, but
have their natural share at least, for which the named ones are scaled down; an empty table gives none; the new columns
get underscores before their names where docs has such a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table, written_once

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 100_000
ROUNDS, TOLERANCE = 60, 1e-9
#: Production targets: sources and topics tempered by this power of their share, languages as named.
TEMPER = 0.5
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
BUDGET, SEED = 0.6, 20240229


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by rules: tables, contact data, licences, symbols, shouting, numbers, or else prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    count = lambda chars: size - F.length(F.regexp_replace(t, f"[{chars}]+", ""))
    return (
        F.when(count("|") * 40 > size, "table")
        .when(count("#$%&*") * 20 > size, "symbols")
        .when(count("!") * 40 > size, "shouting")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.contains(t, F.lit("licensed under")), "licence")
        .when(count("0-9") * 50 > size, "numbers")
        .otherwise("prose")
    )


def left_over(target: dict, unnamed: int, everything: int) -> float:
    """The share of values without a target: what the targets leave, and their natural share at least."""
    return max(1 - sum(target.values()), unnamed / everything) if unnamed else 0.0


def shares(totals: dict, target: dict | float) -> dict:
    """Target shares that sum to 1 over the values that occur: a power of the natural share, or named ones."""
    everything = sum(totals.values())
    if not everything:
        return {v: 1 / len(totals) for v in totals}
    if isinstance(target, dict):
        named = {v: target[v] for v in totals if v in target}
        rest = {v: n for v, n in totals.items() if v not in target}
        unnamed = sum(rest.values())
        left = left_over(target, unnamed, everything)
        fit = (1 - left) / (sum(named.values()) or 1)
        raw = {v: x * fit for v, x in named.items()} | {v: left * n / max(1, unnamed) for v, n in rest.items()}
    else:
        raw = {v: (n / everything) ** target if n else 0.0 for v, n in totals.items()}
    scale = sum(raw.values())
    return {v: x / scale for v, x in raw.items()} if scale else {v: n / everything for v, n in totals.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells that sum to 1 and meet each dimension's shares."""
    weight = tokens.astype(float) / max(1, tokens.sum())
    index, wanted = [], []
    for d, target in enumerate(targets):
        values = list(target)
        index.append(np.array([values.index(c[d]) for c in cells], int))
        wanted.append(np.array([target[v] for v in values]))
    for _ in range(rounds):
        worst = 0.0
        for i, w in zip(index, wanted):
            have = np.bincount(i, weight, len(w))
            worst = max(worst, float(np.abs(have - w)[have > 0].max(initial=0)))
            weight = weight * np.divide(w, have, out=np.zeros(len(w)), where=have > 0)[i]
        weight /= weight.sum() or 1
        if worst < TOLERANCE:
            break
    return weight


def probabilities(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * weight / tokens) of each cell, with the scale at which the expected tokens are budget * all."""
    rate = np.divide(weight, tokens, out=np.zeros(len(weight)), where=tokens > 0)
    full = np.zeros(len(weight), bool)
    wanted, scale = min(1.0, budget) * tokens.sum(), 0.0
    for _ in range(len(weight) + 1):
        open_weight = weight[~full].sum()
        scale = (wanted - tokens[full].sum()) / open_weight if open_weight > 0 else 0.0
        more = ~full & (scale * rate > 1)
        if not more.any():
            break
        full |= more
    # Cells whose documents have no token are kept at the budget.
    return np.where(tokens > 0, np.where(full, 1.0, np.minimum(1.0, scale * rate)), min(1.0, budget))


def _rake_table(cells: DataFrame, targets: list[DataFrame], budget: float, rounds: int) -> DataFrame:
    """The same for more cells than the driver should hold: cells(source, lang, topic, tokens) with p."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(max(1, total))))
    for _ in range(rounds):
        for d, target in zip(DIMENSIONS, targets):
            have = now.groupBy(d).agg(F.sum("w").alias("have"))
            factor = have.join(target, have[d].eqNullSafe(target["value"])).select(have[d].alias("v"), F.when(F.col("have") > 0, F.col("share") / F.col("have")).otherwise(0.0).alias("f"), F.abs(F.col("share") - F.col("have")).alias("gap"), "have")
            now = now.join(factor.drop("gap", "have"), now[d].eqNullSafe(F.col("v"))).withColumn("w", F.col("w") * F.col("f")).drop("v", "f")
        now = cut(now)
        worst = max(now.groupBy(d).agg(F.sum("w").alias("have")).join(t, F.col(d).eqNullSafe(F.col("value"))).where("have > 0").agg(F.max(F.abs(F.col("share") - F.col("have")))).first()[0] or 0.0 for d, t in zip(DIMENSIONS, targets))
        if worst < TOLERANCE:
            break
    rate, bound = F.col("w") / F.col("tokens"), float("inf")
    while True:
        parts = now.where("tokens > 0").agg(F.sum(F.when(rate < bound, F.col("w"))).alias("w"), F.sum(F.when(rate >= bound, F.col("tokens"))).alias("t")).first()
        scale = (min(1.0, budget) * total - (parts.t or 0)) / parts.w if parts.w else 0.0
        if scale <= 0 or 1 / scale >= bound or not now.where(F.col("tokens") > 0).where((rate < bound) & (rate > 1 / scale)).limit(1).count():
            break
        bound = 1 / scale
    return now.withColumn("p", F.when(F.col("tokens") > 0, F.when(rate >= bound, 1.0).otherwise(F.least(F.lit(1.0), rate * scale))).otherwise(min(1.0, budget)))


def mix(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, topic: Column | None = None, text: str = "text", seed: int = SEED, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, prefix: str = "mix_", keep_text: bool = True) -> DataFrame:
    """docs with columns mix_topic, mix_tokens, mix_weight (share of the mix per token over the natural one), mix_probability and mix_kept. keep_text: whether the text stays."""
    targets = targets or {"source": TEMPER, "lang": LANGUAGES, "topic": TEMPER}
    name = {k: free_name(docs, prefix + k) for k in ("topic", "tokens", "weight", "probability", "kept")}
    counted = docs.withColumns({name["topic"]: topic if topic is not None else topic_of(F.col(text)), name["tokens"]: tokens_of(F.col(text)), (draw := free_name(docs, prefix + "draw")): F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)), 11) / F.lit(float(1 << 53))})
    counted = written_once(counted if keep_text else counted.drop(text), "mix")
    keys = ["source", "lang", name["topic"]]
    cells = counted.groupBy(*keys).agg(F.sum(name["tokens"]).alias("tokens")).select(F.col("source"), F.col("lang"), F.col(name["topic"]).alias("topic"), "tokens")
    cells = cut(cells)
    spark = docs.sparkSession
    if cells.count() <= max_cells:
        rows = sorted(cells.collect(), key=lambda r: tuple((x is not None, str(x)) for x in r[:3]))
        got, tokens = [tuple(r)[:3] for r in rows], np.array([r.tokens for r in rows], np.int64)
        totals = [{} for _ in DIMENSIONS]
        for c, n in zip(got, tokens.tolist()):
            for d in range(3):
                totals[d][c[d]] = totals[d].get(c[d], 0) + n
        weight = rake(got, tokens, [shares(totals[d], targets[k]) for d, k in enumerate(DIMENSIONS)], rounds) if rows else np.zeros(0)
        p = probabilities(weight, tokens, budget)
        lift = np.divide(weight * max(1, tokens.sum()), tokens, out=np.zeros(len(p)), where=tokens > 0)
        result = F.broadcast(spark.createDataFrame([(*c, float(a), float(b)) for c, a, b in zip(got, lift, p)], "source string, lang string, topic string, lift double, p double"))
    else:
        wanted = []
        for d, k in enumerate(DIMENSIONS):
            totals = cells.groupBy(F.col(k).alias("value")).agg(F.sum("tokens").alias("n"))
            if isinstance(targets[k], dict):
                named = {v: x for v, x in targets[k].items()}
                known = F.coalesce(F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("value")], F.lit(None).cast("double")) if named else F.lit(None).cast("double")
                s = totals.select("value", "n", known.alias("t"))
                sums = s.agg(F.sum("t").alias("t"), F.sum(F.when(F.col("t").isNull(), F.col("n"))).alias("n"), F.sum("n").alias("everything")).first()
                left = left_over(named, sums.n or 0, sums.everything or 1)
                raw = s.select("value", F.coalesce(F.col("t") * F.lit((1 - left) / (sums.t or 1)), F.col("n") * F.lit(left / max(1, sums.n or 0))).alias("share"))
            else:
                raw = totals.select("value", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(targets[k]))).otherwise(0.0).alias("share"))
            scale = raw.agg(F.sum("share")).first()[0] or 1.0
            wanted.append(cut(raw.withColumn("share", F.col("share") / F.lit(scale))))
        total = cells.agg(F.sum("tokens")).first()[0] or 1
        result = _rake_table(cells, wanted, budget, rounds).select("source", "lang", "topic", F.coalesce(F.col("w") * F.lit(float(total)) / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0)).alias("lift"), "p")
    s, l, t = (free_name(counted, f"cell_{k}") for k in DIMENSIONS)
    met = result.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("lift").alias(name["weight"]), F.col("p").alias(name["probability"]))
    joined = counted.join(met, counted["source"].eqNullSafe(F.col(s)) & counted["lang"].eqNullSafe(F.col(l)) & counted[name["topic"]].eqNullSafe(F.col(t)), "left").drop(s, l, t)
    return joined.withColumn(name["kept"], F.col(draw) < F.col(name["probability"])).drop(draw)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep_text=False)
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))
