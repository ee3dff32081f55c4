"""Edits, confirmation, search and replace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.patterns import java_pattern, java_template
from textloom.operators.segments import confirmable, stale


def edit(segments: DataFrame, seg_id: int, text: str) -> DataFrame:
    """A person's translation: the flag goes."""
    this = F.col("id") == seg_id
    out = segments.withColumn("tgt_text", F.when(this, F.lit(text)).otherwise(F.col("tgt_text"))).withColumn("status", F.when(this, "human_edited").otherwise(F.col("status")))
    return out.withColumn("review_flag", F.when(this, F.lit(False)).otherwise(F.col("review_flag")))


def confirm(segments: DataFrame, which: Column | None = None) -> DataFrame:
    """Confirm what can be confirmed among ``which`` (all by default): its flag goes."""
    hit = confirmable() & F.col("translatable")
    hit = hit if which is None else hit & which
    marked = segments.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    new = {"status": F.when(F.col("__hit"), "confirmed").otherwise(F.col("status")), "review_flag": F.when(F.col("__hit"), F.lit(False)).otherwise(F.col("review_flag"))}
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns])


def mark_retranslate(segments: DataFrame, which: Column) -> DataFrame:
    return segments.withColumn("status", F.when(which, "pending").otherwise(F.col("status")))


def mark_stale(segments: DataFrame, cfg_hash: str) -> DataFrame:
    """Machine translations made with other settings go back to pending; edited and confirmed ones never do."""
    return mark_retranslate(segments, F.col("translatable") & (F.col("status") == "machine_translated") & stale(cfg_hash))


def search_replace(segments: DataFrame, find: str, replacement: str, doc_id: int | None = None, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    r"""Preview (id, doc_id, before, after, n) of the targets that have a match; the replacement is a template (\1, \g<name>, \n) in both modes.

    ``find`` is a text or, with ``regex``, a pattern as Python's ``re`` reads it; one that is wrong or has no counterpart in Java is a ``PatternError``.
    """
    flags = 0 if case_sensitive else re.IGNORECASE
    found = java_pattern(find, flags) if regex else T.quoted(find, case_sensitive)
    pattern, template = F.lit(found), java_template(replacement, find if regex else re.escape(find), flags)
    rows = segments.filter("tgt_text <> ''")
    rows = rows if doc_id is None else rows.filter(F.col("doc_id") == doc_id)
    n = F.regexp_count("tgt_text", pattern)
    return rows.filter(n > 0).select("id", "doc_id", F.col("tgt_text").alias("before"), F.regexp_replace("tgt_text", pattern, F.lit(template)).alias("after"), n.alias("n"))


def apply_preview(segments: DataFrame, preview: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, changes) with the preview's texts; changes (seg_id, before, status_before) undo it."""
    p = preview.select(F.col("id").alias("__id"), F.col("after").alias("__after"))
    out = segments.join(p, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    changes = out.filter(hit).select(F.col("id").alias("seg_id"), F.col("tgt_text").alias("before"), F.col("status").alias("status_before"))
    new = {"tgt_text": F.when(hit, F.col("__after")).otherwise(F.col("tgt_text")), "status": F.when(hit, "human_edited").otherwise(F.col("status"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns]), changes
