"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor over the parts writes texts escaped
and puts an ordered placeholder for each attachment, records the attachment's reference and the tokens that the
placeholder stands for, and keeps where the assistants' texts lie (the loss mask). The template is

    <|turn|>ROLE<|text|>CONTENT<|end|>LF

In roles and texts `\\` is written `\\\\` and `<|` is written `<\\|`, so no control string can arise inside one and
unescaping (each `\\x` is x) restores it. Placeholders are the only other `<|`.

A conversation becomes one string, so its turns meet in one row; different conversations never do.

Defined cases: turns are ordered by turn (null first), role, text; repeated rows are repeated turns; a null role or
text is empty; a null part is left out; a null conv_id is a conversation of its own; an empty table gives none. Only the
named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Tokens that an attachment expands to: for each one, and for each unit of its size (seconds, pages).
EXPANSION = {"image": (576, 0), "audio": (2, 25), "document": (8, 512)}
PARTS = "array<struct<type:string,text:string,ref:string,size:double>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn's content that is text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size")))


def _tokens(part: Column) -> Column:
    cost = F.lit(0).cast("long")
    for kind, (each, unit) in EXPANSION.items():
        cost = F.when(part["type"] == kind, F.lit(each) + F.ceil(F.greatest(F.coalesce(part["size"], F.lit(0.0)), F.lit(0.0)) * unit)).otherwise(cost)
    return cost


def flatten_parts(parts: Column) -> Column:
    """The visitor: struct(written, spans of texts, attachments) of one turn; positions count code points from the turn's content on."""
    start = F.expr("named_struct('written', '', 'spans', cast(array() as array<struct<start:int,size:int>>), 'attached', cast(array() as array<struct<type:string,ref:string,tokens:bigint>>))")

    def visit(acc: Column, part: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        body = escape(F.coalesce(part["text"], F.lit("")))
        return F.struct(
            F.concat(acc["written"], F.when(is_text, body).otherwise(F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), F.size(acc["attached"]).cast("string"), F.lit("|>")))).alias("written"),
            F.when(is_text, F.concat(acc["spans"], F.array(F.struct(F.length(acc["written"]).alias("start"), F.length(body).alias("size"))))).otherwise(acc["spans"]).alias("spans"),
            F.when(is_text, acc["attached"]).otherwise(F.concat(acc["attached"], F.array(F.struct(part["type"].alias("type"), part["ref"].alias("ref"), _tokens(part).alias("tokens"))))).alias("attached"),
        )

    return F.aggregate(F.filter(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), lambda p: p.isNotNull()), start, visit)


def format_conversations(rows: DataFrame, parts: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (start, size in code points of formatted), attachments (turn by turn), expanded_tokens.

    parts names a column of PARTS; without it each turn is one text part.
    """
    content = F.col(parts) if parts else text_part(F.col(text))
    order_text = F.array_join(F.transform(content, lambda p: F.coalesce(p["text"], F.lit(""))), "\0")
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), order_text.alias("by"), flatten_parts(content).alias("flat")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), t["flat"]["written"], F.lit(END)))
    laid = whole.select("conv_id", "turns", pieces.alias("pieces"))
    # Where each turn begins: running sums of the pieces' lengths, then each assistant text's place in the whole.
    begins = laid.withColumn("at", F.aggregate("pieces", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p)))))
    spans = F.flatten(
        F.zip_with("turns", F.slice("at", 1, F.size("turns")), lambda t, at: F.transform(
            F.when(t["role"] == "assistant", t["flat"]["spans"]).otherwise(F.expr("cast(array() as array<struct<start:int,size:int>>)")),
            lambda s: F.struct((at + F.length(escape(t["role"])) + len(TURN) + len(TEXT) + s["start"]).alias("start"), s["size"].alias("size")),
        ))
    )
    attached = F.flatten(F.transform("turns", lambda t: t["flat"]["attached"]))
    return begins.select("conv_id", F.array_join("pieces", "").alias("formatted"), spans.alias("loss_spans"), attached.alias("attachments")).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse_turns(formatted: Column) -> Column:
    """array<struct(role, content)> read back from the formatted string; content is unescaped, placeholders stay."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, F.length(p)), TEXT, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit(TEXT)) + len(TEXT), F.length(p))).alias("content"),
    ))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS x").select(F.lit(-7).cast("long").alias("conv_id"), "x.turn", "x.role", F.lit(said).alias("text"))
    done = format_conversations(rows.unionByName(extra))
    read = done.select("conv_id", "formatted", "expanded_tokens", F.size("attachments").cast("long").alias("n_attachments"), parse_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )


_SAID = r"\### Assistant: </turn> ok"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + {len(TURN) + len(TEXT) + len(END)}) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""
