"""Reading and counting segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.store import TRANSLATED


def list_segments(segments: DataFrame, doc_id: int | None = None, translatable: bool | None = None, status_in: tuple[str, ...] | None = None, search: str | None = None, review_flag: bool | None = None) -> DataFrame:
    """Conjunction of the filters that are given, in document order."""
    out = segments
    if doc_id is not None:
        out = out.filter(F.col("doc_id") == doc_id)
    if translatable is not None:
        out = out.filter(F.col("translatable") == translatable)
    if status_in:
        out = out.filter(F.col("status").isin(list(status_in)))
    if review_flag is not None:
        out = out.filter(F.col("review_flag") == review_flag)
    if search:
        out = out.filter(T.like(F.col("src_text"), search) | T.like(F.col("tgt_text"), search))
    return out.orderBy("doc_id", "seq")


def in_document_order(segments: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Segments of the documents in the order the caller names them; an empty list means all."""
    if not doc_ids:
        return segments.orderBy("doc_id", "seq")
    place = F.array_position(F.array(*[F.lit(i).cast("long") for i in doc_ids]), F.col("doc_id"))
    return segments.filter(F.col("doc_id").isin(doc_ids)).orderBy(place, "seq")


def with_paths(segments: DataFrame, docs: DataFrame) -> DataFrame:
    return segments.join(docs.select(F.col("id").alias("doc_id"), F.col("path").alias("doc_path")), "doc_id", "left")


def confirmable_stored() -> Column:
    """As the store counts it: only U+0020 is trimmed."""
    return F.col("translatable") & (F.col("status") != "confirmed") & F.col("tgt_text").isNotNull() & (F.trim("tgt_text") != "")


def confirmable() -> Column:
    """As the review sees it: all white space is trimmed."""
    return (F.col("status") != "confirmed") & ~T.is_blank(F.col("tgt_text"))


def stale(cfg_hash: str) -> Column:
    return F.col("status").isin(list(TRANSLATED)) & ~F.col("cfg_hash").eqNullSafe(F.lit(cfg_hash))


def suspicious(tgt: Column, langs_differ: bool, policy: Column | None = None) -> Column:
    """A translation to try again: blank, equal to the source, slots changed, or all reading slots lost."""
    src = F.col("src_text")
    out = T.is_blank(tgt) | ~T.slots_match(src, tgt)
    if langs_differ:
        out = out | (T.strip(tgt) == T.strip(src))
    if policy is not None:
        out = out | (F.coalesce(policy.isin("keep", "translate"), F.lit(False)) & T.has_ruby(src) & ~T.has_ruby(tgt))
    return F.coalesce(out, F.lit(True))


def status_counts(segments: DataFrame) -> DataFrame:
    return segments.filter("translatable").groupBy("status").agg(F.count("*").alias("n"))


def document_states(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, total, done, confirmed, state) with the label that a document list shows."""
    agg = segments.filter("translatable").groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(list(TRANSLATED))).alias("done"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    out = docs.select("id").join(agg, F.col("id") == F.col("doc_id"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "done", "confirmed")])
    part = lambda name, n: F.concat(F.lit(name + " "), n.cast("string"), F.lit("/"), F.col("total").cast("string"))
    state = (
        F.when(F.col("total") == 0, "无内容")
        .when(F.col("done") == 0, part("未翻译", F.lit(0)))
        .when(F.col("done") < F.col("total"), part("翻译中", F.col("done")))
        .when(F.col("confirmed") == F.col("total"), part("已校对完成", F.col("confirmed")))
        .otherwise(part("已翻译待校对", F.col("done")))
    )
    return out.withColumn("state", state)


def precheck(segments: DataFrame, cfg_hash: str, slide: int = 0) -> DataFrame:
    """One row before a run: pending segments and characters, stale segments, documents, token estimates."""
    todo = F.col("translatable") & F.col("status").isin("pending", "failed")
    row = segments.agg(
        F.count_if(todo).alias("pending"),
        F.coalesce(F.sum(F.when(todo, F.length("src_text"))), F.lit(0)).alias("chars"),
        F.count_if(F.col("translatable") & stale(cfg_hash)).alias("stale"),
        F.countDistinct("doc_id").alias("docs"),
    )
    row = row.withColumn("tokens_in", T.estimate_in(F.col("chars"), slide))
    return row.withColumn("tokens_out", T.estimate_out(F.col("tokens_in")))


def import_counts(segments: DataFrame) -> DataFrame:
    """(doc_id, total, translatable, reused) after an import."""
    return segments.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("translatable").alias("n_translatable"), F.count_if(F.col("translatable") & F.col("tgt_text").isNotNull()).alias("reused"))


def confirm_block_reason(segments: DataFrame) -> DataFrame:
    """Why a selection can't be confirmed: how many are blank, how many are confirmed already."""
    return segments.agg(F.count_if(T.is_blank(F.col("tgt_text"))).alias("blank"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
