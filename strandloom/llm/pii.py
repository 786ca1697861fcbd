"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from regular expressions: the base forms, which always count as personal data, and looser ones that
also match what is none: version numbers, account and order numbers, assignments of any name. Four labelers that the
candidates' patterns don't imply vote on each: a strict form, a gazetteer, cue words before it, and its shape. Counts of
vote patterns over the whole corpus go into expectation-maximisation (per kind, a pattern table of bounded size), which
estimates how reliable each labeler is; the soft labels then train a naive Bayes classifier of spans on the votes and
the span's length, and the looser candidates that it accepts join the base spans.

Patterns are possessive and anchored to the start of a run, so each scan takes time in proportion to the text. Texts are
scanned once: the candidates are written to the shared folder, the model is fitted on them and applied to them.
Positions count code points: the text is split at the matches, and lengths of gaps and matches add up.

Defined cases: a null text is empty; repeated rows each get a row; of candidates at one place each kind has its own; a
column of docs named as the output is replaced; a model of an empty table accepts only base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, written_once

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The forms looked for; each matches what its plain form does, but from a run's start on and without going back.
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LOOSE_PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++|@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-]))",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]?[\x20-][0-9(][0-9()\x20-]{5,14}[0-9])(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9_/+=-]{8,}+",
}
#: Cheap tests of whether a loose form can occur at all.
LOOSE_GUARDS = {"email": ("[at]", "(at)", "[AT]", "(AT)", "@"), "ip": (".",), "card": (), "phone": (), "secret": ("=", ":")}
#: Fixed values, patterns of the labelers: a span's strict form, gazetteer entries, and cue words in the CONTEXT characters before it.
STRICT = {
    "email": r"\.[A-Za-z]{2,}$",
    "ip": rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$",
    "phone": r"^(?:\+|00|\([2-9][0-9]{2}\)|[2-9][0-9]{2}[.-])",
    "secret": r"(?:[A-Fa-f0-9]{32,}|[A-Za-z0-9_/+-]*[0-9][A-Za-z_/+-]+[0-9][A-Za-z0-9_/+=-]{12,})$",
}
GAZETTEER = {
    "email": r"(?i)(?:gmail|yahoo|outlook|hotmail|proton|mail)|(?:com|org|net|edu|gov|de|fr|es|io)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.(?!0\.[0-9]+$)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+|00)?(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[\x20().-]|^\(?[2-9][0-9]{2}\)?[\x20.-]",
    "secret": r"(?i)^[A-Za-z0-9_.-]*(?:token|secret|passw|pwd|api[_-]?key|private|credential|auth)",
}
CUES = {
    "email": r"(?i)e-?mail|contact|courriel|correo|write|reply",
    "ip": r"(?i)\bip\b|host|address|server|addr",
    "card": r"(?i)card|visa|master|carte|karte|tarjeta|credit",
    "phone": r"(?i)tel|phone|call|fax|mobil|tél|anruf",
    "secret": r"(?i)auth|bearer|config|export|env|login",
}
CONTEXT, LABELERS, BUCKETS, ROUNDS = 24, 4, 8, 25
#: The bit of votes that says that a span can't be one of its kind.
AGAINST = 1 << LABELERS


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.element_at(doubled, digit(i) + 1)).otherwise(digit(i))) % 10 == 0


def is_base(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _digits_apart(x: Column) -> Column:
    return F.size(F.array_distinct(F.split(_digits(x), "")))


def _strict(kind: str, x: Column) -> Column:
    """The span in its kind's strict form, which no loose pattern demands."""
    form = x.rlike(STRICT[kind])
    if kind == "card":
        return form & luhn(_digits(x))
    if kind == "phone":
        return form & F.length(_digits(x)).between(10, 15)
    return form


def _against(kind: str, x: Column) -> Column:
    """What a labeler may say beside yes and nothing: that a span can't be of its kind, as its checksum or its range fails. That is decisive."""
    if kind == "card":
        return ~luhn(_digits(x))
    if kind == "ip":
        return ~x.rlike(STRICT["ip"])
    if kind == "phone":
        return ~F.length(_digits(x)).between(7, 15)
    return F.lit(False)


def _shape(kind: str, x: Column) -> Column:
    """Whether the span varies as one of its kind would: neither repeated signs nor round numbers."""
    if kind == "secret":
        return F.size(F.array_distinct(F.split(F.regexp_extract(x, "[A-Za-z0-9_/+=-]+$", 0), ""))) >= 10
    if kind in ("card", "phone"):
        return (_digits_apart(x) >= 5) & ~x.rlike("0000$")
    if kind == "ip":
        return x.rlike(r"[0-9]{2,}\.[0-9]*\.?[0-9]{2,}") | (F.length(x) >= 11)
    return F.length(x).between(6, 64) & x.rlike("^[A-Za-z0-9]")


def _bit(test: Column, bit: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(1 << bit)).otherwise(F.lit(0))


def _spans(kind: str, matches: Column, gaps: Column, base: bool) -> Column:
    """array<struct(kind, start, end, votes, bucket, base)>; votes of those that pass."""
    begin = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,size:int,text:string,before:string>>))")
    laid = F.aggregate(
        F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        begin,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), F.length(x["m"]).alias("size"), x["m"].alias("text"), F.right(x["g"], F.lit(CONTEXT)).alias("before")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = F.filter(laid, lambda s: is_base(kind, s["text"])) if base else laid
    return F.transform(kept, lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        s["start"].alias("start"),
        (s["start"] + s["size"]).alias("end"),
        (_bit(_strict(kind, s["text"]), 0) + _bit(s["text"].rlike(GAZETTEER[kind]), 1) + _bit(s["before"].rlike(CUES[kind]), 2) + _bit(_shape(kind, s["text"]), 3) + (F.lit(0) if base else _bit(_against(kind, s["text"]), LABELERS))).alias("votes"),
        F.least(F.floor(F.log2(s["size"])), F.lit(BUCKETS - 1)).cast("int").alias("bucket"),
        F.lit(base).alias("base"),
    ))


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """docs with an array of candidate spans: all base ones, and loose ones that overlap none of them."""
    docs = docs.drop(out)
    t = free_name(docs, "pii_text")
    step = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    none, empty = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<kind:int,start:int,end:int,votes:int,bucket:int,base:boolean>>)")
    forms = [(k, p, True, f"pii_b_{k}") for k, p in BASE_PATTERNS.items()] + [(k, p, False, f"pii_l_{k}") for k, p in LOOSE_PATTERNS.items()]
    guard = {"email": F.instr(F.col(t), "@") > 0, "phone": F.instr(F.col(t), "+") > 0}

    def found(kind: str, pattern: str, base: bool) -> Column:
        every = F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0))
        if base:
            return F.when(guard[kind], every).otherwise(none) if kind in guard else every
        words = LOOSE_GUARDS[kind]
        if not words:
            return every
        test = F.contains(F.col(t), F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(F.col(t), F.lit(w))
        return F.when(test, every).otherwise(none)

    # Three steps, so that no regular expression is evaluated twice.
    step = step.select("*", *[found(k, p, b).alias(f"{t}_{n}") for k, p, b, n in forms])
    step = step.select("*", *[F.when(F.size(f"{t}_{n}") > 0, F.split(F.col(t), p, -1)).alias(f"{t}_{n}_g") for k, p, b, n in forms])
    made = {b: F.concat(*[F.when(F.size(f"{t}_{n}") > 0, _spans(k, F.col(f"{t}_{n}"), F.col(f"{t}_{n}_g"), b)).otherwise(empty) for k, p, bb, n in forms if bb == b]) for b in (True, False)}
    step = step.select(*docs.columns, made[True].alias(f"{t}_b"), made[False].alias(f"{t}_l"))
    loose = F.filter(f"{t}_l", lambda s: ~F.exists(f"{t}_b", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return step.select(*docs.columns, F.concat(f"{t}_b", F.when(F.size(f"{t}_l") > 0, loose).otherwise(empty)).alias(out))


def _likelihood(offset: int) -> str:
    return " * ".join(f"if(c.votes & {1 << i} <> 0, p[{offset + i}], 1D - p[{offset + i}])" for i in range(LABELERS))


def fit(found: DataFrame, column: str = "candidates") -> dict[int, list[float]]:
    """By kind, the classifier's log-odds: the prior, then each labeler's for a vote and for none, then each length bucket's.

    Vote patterns are counted before they meet, and the table of a kind has at most 2 * 2**LABELERS * BUCKETS rows. Spans
    with a vote against them count as none of their kind from the start, so the labelers' errors are learned from known ones, too.
    """
    counts = found.select(F.explode(column).alias("s")).groupBy("s.kind", "s.votes", "s.bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "bucket", "n"))).alias("cells"))
    pos, neg = 1, 1 + LABELERS
    soft = f"transform(cells, c -> named_struct('votes', c.votes, 'bucket', c.bucket, 'n', c.n, 'q', if(c.votes & {AGAINST} <> 0, 0D, p[0] * {_likelihood(pos)} / (p[0] * {_likelihood(pos)} + (1D - p[0]) * {_likelihood(neg)}))))"
    total = lambda what, of="true": f"aggregate(w, 0D, (a, c) -> a + if({of}, c.n * {what}, 0D))"
    # Pseudo-counts say that a labeler is rather right than wrong, which also fixes which class is which.
    rates = [f"({total('c.q', f'c.votes & {1 << i} <> 0')} + 8D) / ({total('c.q')} + 10D)" for i in range(LABELERS)]
    false = [f"({total('(1D - c.q)', f'c.votes & {1 << i} <> 0')} + 2D) / ({total('(1D - c.q)')} + 10D)" for i in range(LABELERS)]
    prior = f"({total('c.q')} + 1D) / ({total('1D')} + 2D)"
    step = f"element_at(transform(array({soft}), w -> array({', '.join([prior, *rates, *false])})), 1)"
    start = f"array(0.5D, {', '.join(['0.8D'] * LABELERS + ['0.2D'] * LABELERS)})"
    fitted = cells.withColumn("p", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (p, i) -> {step})"))
    odds = [f"ln(p[0] / (1D - p[0]))"] + [f"ln({a})" for i in range(LABELERS) for a in (f"p[{pos + i}] / p[{neg + i}]", f"(1D - p[{pos + i}]) / (1D - p[{neg + i}])")]
    lengths = [f"ln((({total('c.q', f'c.bucket = {b}')} + 1D) / ({total('c.q')} + {BUCKETS}D)) / (({total('(1D - c.q)', f'c.bucket = {b}')} + 1D) / ({total('(1D - c.q)')} + {BUCKETS}D)))" for b in range(BUCKETS)]
    model = fitted.withColumn("w", F.expr(soft)).select("kind", F.expr(f"array({', '.join(odds + lengths)})").alias("odds"))
    return {r.kind: list(r.odds) for r in model.collect()}  # one row of fixed size for each kind


def accepted(column: Column, model: dict[int, list[float]], threshold: float = 0.0) -> Column:
    """The base spans, and the loose ones that nothing speaks against and whose log-odds exceed the threshold, by kind and start."""

    def score(s: Column) -> Column:
        out = F.lit(float("-inf"))
        for kind, odds in model.items():
            value = F.lit(odds[0])
            for i in range(LABELERS):
                value = value + F.when(s["votes"].bitwiseAND(1 << i) != 0, odds[1 + 2 * i]).otherwise(odds[2 + 2 * i])
            value = value + F.element_at(F.array(*[F.lit(x) for x in odds[1 + 2 * LABELERS :]]), s["bucket"] + 1)
            out = F.when(s["kind"] == kind, value).otherwise(out)
        return out

    return F.array_sort(F.filter(column, lambda s: s["base"] | ((s["votes"].bitwiseAND(AGAINST) == 0) & (score(s) > threshold))))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", out: str = "spans", keep_text: bool = True) -> DataFrame:
    """docs with the accepted spans; the model is fitted on these docs. keep_text: whether the text stays a column."""
    found = candidates(docs, text, out)
    found = written_once(found if keep_text else found.drop(text), "pii")
    return found.withColumn(out, accepted(F.col(out), fit(found, out)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `[KIND]` in place of each span; where spans overlap, the first one's kind stands for both."""
    name = free_name(docs, "spans")
    found = find(docs, text, name)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col(text)
    ordered = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rest = F.aggregate(
        ordered,
        F.expr("named_struct('at', 0, 'out', '')"),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(tags, s["kind"] + 1))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size(name) > 0, rest).otherwise(body)).select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
