"""Tables, schemas, and changes of state as joins.

Tables are immutable snapshots: a change is a new DataFrame. Updates are matched by key, and a null field in
an update means "leave it", so a field can't be cleared that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.keep import keeper

SEGMENTS = (
    "id long, doc_id long, seq long, src_text string, src_hash string, tgt_text string, status string, is_heading boolean, translatable boolean, "
    "cfg_hash string, review_flag boolean, ruby_map map<string,string>, ruby_src array<struct<token:string,base:string,rt:string,style:string>>"
)
DOCUMENTS = "id long, path string, format string, content_hash string, tags map<string,string>, terms_extracted boolean, status string"
TERMS = "ord int, src string, cands array<string>, note string, origin string, status string, occurrences int"
REVISIONS = "id long, saved_at double, content_hash string, payload string"
RUNS = "id long, type string, status string, total long, done long, failed long, tokens_in long, tokens_out long, cost double, error string, created_at double, finished_at double"
RUN_ITEMS = "id long, run_id long, segment_id long, status string, retries long, error string"

TRANSLATED = ("machine_translated", "human_edited", "confirmed")
#: Preference of a stored translation: the smallest wins.
RANK = {"confirmed": 0, "human_edited": 1, "machine_translated": 2}


def rank(status: Column) -> Column:
    out = F.lit(9)
    for s, r in RANK.items():
        out = F.when(status == s, r).otherwise(out)
    return out


def migrate(df: DataFrame, schema: str) -> DataFrame:
    """Bring an older table to the current schema: missing columns become null, the order is fixed."""
    from pyspark.sql.types import _parse_datatype_string

    want = _parse_datatype_string(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def update(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Left join of at most one change per key; null fields leave the old value."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    out = df.join(new, df[key] == F.col("__key"), "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def upsert_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (path, format, content_hash) replaces format and hash of known paths and appends others; ids go on from the largest.

    A changed hash resets terms_extracted. The ids of new paths follow the order of the paths.
    """
    n = new.select(F.col("path").alias("__path"), F.col("format").alias("__format"), F.col("content_hash").alias("__hash"))
    known = docs.join(n, F.col("path") == F.col("__path"), "left")
    changed = F.col("__hash").isNotNull() & ~F.col("__hash").eqNullSafe(F.col("content_hash"))
    kept = known.select(
        "id", "path", F.coalesce("__format", "format").alias("format"), F.coalesce("__hash", "content_hash").alias("content_hash"), "tags",
        F.when(changed, F.lit(False)).otherwise(F.col("terms_extracted")).alias("terms_extracted"), F.when(F.col("__path").isNotNull(), "segmented").otherwise(F.col("status")).alias("status"),
    )
    fresh = n.join(docs, F.col("path") == F.col("__path"), "left_anti")
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    ids = numbered(fresh, ["__path"], "__n")
    added = ids.crossJoin(F.broadcast(top)).select(
        (F.col("__top") + F.col("__n")).alias("id"), F.col("__path").alias("path"), F.col("__format").alias("format"), F.col("__hash").alias("content_hash"),
        F.create_map().cast("map<string,string>").alias("tags"), F.lit(False).alias("terms_extracted"), F.lit("segmented").alias("status"),
    )
    return kept.unionByName(added)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Running number from 1 in the order of ``by`` without one task for all rows: ranges, then their offsets. Ties get numbers in any order.

    The ranges are written once, with their number and the place within them, and both counts and rows are read from there: planned
    twice, the two would be cut differently.
    """
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__mono", F.monotonically_increasing_id())
    spread = keeper(df.sparkSession)(spread, "numbered")
    rows = spread.withColumn("__part", F.shiftright("__mono", 33)).withColumn("__in", F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__base"))  # a row per partition
    out = rows.join(F.broadcast(bases), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__base") + F.col("__in") + 1).drop("__part", "__mono", "__in", "__p", "__base")


def delete_documents(docs: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anti-join on both tables; ``ids`` (id)."""
    gone = ids.select(F.col("id").alias("__id"))
    return docs.join(gone, F.col("id") == F.col("__id"), "left_anti"), segments.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def set_status(segments: DataFrame, condition: Column, status: str, review_flag: bool | None = None) -> DataFrame:
    out = segments.withColumn("status", F.when(condition, status).otherwise(F.col("status")))
    return out if review_flag is None else out.withColumn("review_flag", F.when(condition, F.lit(review_flag)).otherwise(F.col("review_flag")))


def config_hash(style: str, custom: str, tgt: str, terms_hash: str, ruby: str | None = None) -> str:
    """Hash of the settings that make a translation stale; default reading settings are left out."""
    import hashlib
    import json

    payload = {"style": style, "custom": custom, "tgt": tgt, "terms": terms_hash} | ({"ruby": ruby} if ruby else {})
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def with_source(segments: DataFrame, condition: Column, text: Column) -> DataFrame:
    """Edit source texts: the hash follows and the segment is flagged for review."""
    out = segments.withColumn("src_text", F.when(condition, text).otherwise(F.col("src_text")))
    return out.withColumn("src_hash", F.when(condition, T.src_hash(F.col("src_text"))).otherwise(F.col("src_hash"))).withColumn("review_flag", F.when(condition, F.lit(True)).otherwise(F.col("review_flag")))
