"""The provided tables as documents, segments and terms, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

ID_STEP = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input of fewer files than cores; a file with one row group would keep one core busy. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").filter("text is not null"))


def exploded(docs: DataFrame) -> DataFrame:
    """(seq, src_text) for each line of each document, with its other columns; a last line end begins no line."""
    text = T.without_last_newline(T.normalize_eol(F.col("text")))
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("seq", "src_text")).withColumn("seq", F.col("seq").cast("long"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, seq, src_text): the lines of each document."""
    return exploded(documents(spark, sf_dir))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a state from the labels: quality 1 is confirmed, 0 machine translated, no label pending; toxic sets the flag.

    A translated line reads T:<source>; settings differ by document, so that some translations are stale.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = exploded(documents(spark, sf_dir).join(labels, "doc_id", "left"))  # a row a document is joined, not a row a line
    status = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "machine_translated").otherwise("pending")
    rows = rows.withColumn("translatable", ~T.effectively_empty(F.col("src_text")))
    src, translatable = F.col("src_text"), F.col("translatable")
    return rows.select(
        (F.col("doc_id") * ID_STEP + F.col("seq")).alias("id"), "doc_id", "lang", "seq", "src_text", T.src_hash(src).alias("src_hash"),
        F.when(translatable & F.col("quality").isNotNull(), F.concat(F.lit("T:"), src)).alias("tgt_text"), F.when(translatable, status).otherwise("pending").alias("status"),
        "translatable", F.when(translatable, F.when(F.col("doc_id") % 5 == 0, "c0").otherwise("c1")).alias("cfg_hash"), (F.coalesce("toxic", F.lit(0)) == 1).alias("review_flag"),
    )


_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DOUBLED = _WS.replace("{", "{{").replace("}", "}}")
#: SQL templates for ``.format(column)``.
STRIP = "regexp_replace({}, '^[" + _DOUBLED + "]+|[" + _DOUBLED + "]+$', '', 'g')"
EMPTY = r"regexp_replace(regexp_replace({}, '\{{r?[0-9]+\}}', '', 'g'), '[" + _DOUBLED + r"\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]+', '', 'g') = ''"

LINES = """
norm AS (SELECT doc_id, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, lang, string_split(CASE WHEN right(t, 1) = chr(10) THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS parts FROM norm),
line AS (SELECT doc_id, lang, unnest(range(len(parts))) AS seq, unnest(parts) AS src_text FROM cut)"""

SEGMENTS = (
    LINES
    + f""",
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
known AS (SELECT l.*, quality, toxic, NOT ({EMPTY.format('src_text')}) AS translatable FROM line l LEFT JOIN lab USING (doc_id)),
seg AS (
  SELECT doc_id * {ID_STEP} + seq AS id, doc_id, lang, seq, src_text, sha256({STRIP.format('src_text')}) AS src_hash,
    CASE WHEN translatable AND quality IS NOT NULL THEN 'T:' || src_text END AS tgt_text,
    CASE WHEN translatable AND quality = 1 THEN 'confirmed' WHEN translatable AND quality = 0 THEN 'machine_translated' ELSE 'pending' END AS status,
    translatable, CASE WHEN translatable THEN CASE WHEN doc_id % 5 = 0 THEN 'c0' ELSE 'c1' END END AS cfg_hash, coalesce(toxic, 0) = 1 AS review_flag
  FROM known)"""
)

#: A small glossary for the queries: (src, candidates, note), and its state before a change.
GLOSSARY = [("the", ["THE", "La"], "article"), ("and", ["und"], ""), ("est", ["EST"], ""), ("tion", ["T:"], "ending"), ("der", ["the"], ""), ("qzx", ["none"], "")]
FORMER = [("the", ["the", "THE"], "article"), ("and", ["und"], ""), ("est", ["es", "EST"], ""), ("old", ["ol"], "")]


def glossary(spark: SparkSession, rows=None) -> DataFrame:
    rows = GLOSSARY if rows is None else rows
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, src string, cands array<string>, note string")


def glossary_sql(name: str, rows) -> str:
    values = ", ".join(f"({i}, '{s}', [{', '.join(repr(c) for c in cs)}], '{n}')" for i, (s, cs, n) in enumerate(rows))
    return f"{name}(ord, src, cands, note) AS (VALUES {values})"
