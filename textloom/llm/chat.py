"""Chat formatting by a finite-state machine over roles (native).

A declarative ``Template`` says which strings are control strings, how a turn is marked, which
roles bear loss and which role may follow which. Each row becomes three segments (marker, text,
end) with a loss flag each; a window over the conversation runs the machine. Control strings inside a text
or role are broken by a backslash after their first character, and backslashes are doubled, so
the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import table


@dataclass(frozen=True)
class Template:
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    start: str = "<s>[INST] "
    between: str = " [/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: machine: state (the role before, "" at the beginning) -> roles that may come next
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column, t: Template) -> Column:
    cut = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), cut, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: (conv_id, formatted, segments, valid, bad_turn).

    ``segments``: array of (text, loss) whose concatenation is ``formatted``. ``valid``: the machine
    accepts the roles; ``bad_turn``: the 0-based position of the first turn that it refuses. Turns
    are ordered by turn (null first), then role, then text, repeated rows included. Null texts and
    roles count as empty; a null conv_id is a conversation of its own. Other columns are ignored.
    A conversation is one output value and is built in one task, as a document would be.
    """
    t = template or Template()
    base = rows.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    moves = [f"{a}\n{b}" for a, nexts in t.follows.items() for b in nexts]
    seen = base.withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("role", 1, "").over(w))
    seen = seen.withColumn("ok", F.concat("before", F.lit("\n"), "role").isin(moves))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    marks = F.array(
        part(F.concat(F.lit(t.start), escape(F.col("role"), t), F.lit(t.between)), F.lit(False)),
        part(escape(F.col("text"), t), F.col("role").isin(list(t.loss_roles))),
        part(F.lit(t.end), F.lit(False)),
    )
    turns = F.array_sort(F.collect_list(F.struct("i", marks.alias("marks"))))
    out = seen.groupBy("conv_id").agg(turns.alias("turns"), F.min(F.when(~F.col("ok"), F.col("i"))).alias("bad_turn"), F.max_by("role", "i").alias("last"))
    out = out.withColumn("segments", F.flatten(F.transform("turns", lambda x: x["marks"])))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return out.select("conv_id", "formatted", "segments", (F.col("bad_turn").isNull() & F.col("last").isin(list(t.final))).alias("valid"), "bad_turn")


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read ``formatted`` and ``segments`` back: adds ``turns`` (array of role, text) and ``loss_text``."""
    t = template or Template()
    pieces = F.split("formatted", re.escape(t.end), -1)
    body = lambda x: F.substring(x, len(t.start) + 1, 1 << 30)
    at = lambda x: F.instr(body(x), t.between)
    turn = lambda x: F.struct(
        unescape(body(x).substr(F.lit(1), at(x) - 1)).alias("role"), unescape(body(x).substr(at(x) + len(t.between), F.lit(1 << 30))).alias("text")
    )
    out = formatted.withColumn("turns", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return out.withColumn("loss_text", F.array_join(lost, ""))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = read_chats(format_chats(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


_SQL_ESCAPE = r"regexp_replace(replace({}, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
OP7_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
moves AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role, 1, '') OVER w AS before
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, (before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok FROM moves)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_SQL_ESCAPE.format('role')}) + length({_SQL_ESCAPE.format('text')}) + 22) AS BIGINT) AS formatted_chars,
  bool_and(ok) AND arg_max(role, i) = 'assistant' AS valid, min(i) FILTER (NOT ok) AS bad_turn
FROM judged GROUP BY conv_id
"""
