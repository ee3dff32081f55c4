"""Exact deduplication by progressive refinement (native).

Texts are grouped by length, then by a prefix hash, then by a full hash. What the first two
levels found twice or more is passed on as a bitmap (2 MiB; for the prefixes eight bits a row, 64 MiB at most, so it is broadcast
safely): only rows whose bit is set have their full content hashed. A bit shared by chance costs
one needless full hash and nothing else, because groups are formed by the full hash alone. No text
is ever shuffled: only hashes travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, bitmap_log2, has_bit, repeated_bits, stage, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, full_hash, *extra).

    Equal texts form a group; its row with the largest id is kept (``keep_id``). Null texts count
    as empty; null ids sort below all others. If that id occurs in several rows of the group,
    exactly one of them is kept. ``full_hash`` is null where a text was told apart from
    all others by its length or prefix; such rows take no part in the join. ``extra``: more columns over ``__text`` and
    ``__row``, a struct of all input columns. Otherwise the other columns of the input are ignored, so their names can't
    clash. An empty input gives an empty result.
    """
    log2 = bitmap_log2(docs.count())
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    sized = base.withColumn("__k1", F.xxhash64(F.octet_length("__text")))
    by_length = repeated_bits(sized, "__k1")
    with_prefix = has_bit(sized, by_length, "__k1", "__s1").withColumn("__k2", F.when(F.col("__s1"), F.xxhash64(F.octet_length("__text"), F.substring("__text", 1, prefix))))
    by_prefix = stage(repeated_bits(with_prefix.filter("__s1"), "__k2", log2), "exact-bits")
    tested = has_bit(with_prefix, by_prefix, "__k2", "__s2", log2)
    rows = tested.select(
        "__id",
        F.when(F.col("__s2"), F.sha2(F.col("__text").cast("binary"), 256)).alias("full_hash"),
        F.monotonically_increasing_id().alias("__tag"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    rows = stage(rows, "exact-rows")
    hashed = rows.filter("full_hash is not null")
    groups = hashed.groupBy("full_hash").agg(F.max(F.struct("__id", "__tag")).alias("__best"), F.count("*").alias("__n"))
    groups = stage(groups.filter("__n > 1"), "exact-groups")
    alone = rows.filter("full_hash is null")
    for name, kind in groups.drop("full_hash").dtypes:
        alone = alone.withColumn(name, F.lit(None).cast(kind))
    out = attach(hashed, groups, ["full_hash"], "__n", F.col("__tag")).unionByName(alone)
    many = F.col("__n").isNotNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(many, F.col("__best.__id")).otherwise(F.col("__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.when(many, F.col("__best.__tag") == F.col("__tag")).otherwise(F.lit(True)).alias("kept"),
        "full_hash",
        *(extra or {}),
    )


def unique_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns unchanged: one row of each text, whatever ids or rows repeat."""
    return exact_dedup(docs, id_col, text_col, extra={"__whole": F.col("__row")}).filter("kept").select("__whole.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup(docs, extra={"text_sha256": F.sha2(F.col("__text").cast("binary"), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
