"""Importance resampling towards a target (hashed n-grams): documents are drawn by how much likelier their features are in the target than in the corpus.

Each partition counts its features with DuckDB: SQL unnests the words, a window joins runs of them, a registered function (zlib's CRC) deals
them to buckets. A partition's counts, one row a document and one with its totals, leave the task through Spark's Parquet writer
into the shared folder: a lost executor repeats its own partitions, and no file of a task outlives it. Spark adds up the
totals, weighs the buckets and scores documents from the counts that were written, so each text is read once.

The draw is a Gumbel top-k without replacement. Ranks come from a range partitioning by score and the row counts of its
partitions, so no task and no driver sees all scores.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lean, stage, table

BUCKETS = 10_000
#: What a word is, once A-Z are lower case: ASCII letters and digits, and everything beyond ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What DuckDB may use in a task before it writes to the task's own temporary folder.
MEMORY = "256MB"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
COUNTS = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>, total_buckets array<int>, total_counts array<long>"
_KINDS = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64())] * 2


def features_sql(n: int, buckets: int) -> str:
    """Counts by row and bucket of ``batch(row, text)``, for runs of 1 to ``n`` words."""
    longer = "".join(
        f"""
        UNION ALL SELECT row, concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER w" for i in range(1, k))}) FROM words
        WINDOW w AS (PARTITION BY row ORDER BY place) QUALIFY lead(word, {k - 1}) OVER w IS NOT NULL"""
        for k in range(2, n + 1)
    )
    return f"""
    WITH cut AS (SELECT row, regexp_extract_all(text, '{FEATURE_WORD}') AS words FROM batch),
    words AS MATERIALIZED (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
    grams AS MATERIALIZED (SELECT row, word AS gram FROM words{longer}),
    dealt AS MATERIALIZED (SELECT gram, (zlib_crc32(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM grams))
    SELECT row, bucket, count(*) AS n FROM grams JOIN dealt USING (gram) GROUP BY ALL"""


def _lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and nulls as empty texts: one pass over the bytes, as these are ASCII alone in UTF-8."""
    plain = texts.fill_null("")
    _, offsets, data = plain.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(_LOWER)) if data is not None else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.string(), len(plain), [None, offsets, data], offset=plain.offset)


def count_features(docs: DataFrame, n: int, buckets: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged counts: a row for each input row (``row``: its number) and one with the totals of each partition (``row`` null)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as db:
            db.create_function("zlib_crc32", lambda a: pa.array([zlib.crc32(x) for x in a.cast(pa.binary()).to_pylist()], pa.int64()), ["VARCHAR"], "BIGINT", type="arrow")
            db.execute("CREATE TABLE totals (bucket INTEGER, n BIGINT)")
            for batch in batches:
                numbers = pa.array(np.arange(number, number + len(batch)))
                number += len(batch)
                db.register("batch", pa.table({"row": numbers, "text": _lowered(batch.column("text"))}))
                db.execute(f"CREATE OR REPLACE TEMP TABLE counts AS {features_sql(n, buckets)}")
                db.execute("INSERT INTO totals SELECT bucket, sum(n)::BIGINT FROM counts GROUP BY bucket")
                found = db.sql(f"""
                    SELECT row, len(regexp_extract_all(text, '{FEATURE_WORD}')) AS n_words, coalesce(n, 0) AS n_features, coalesce(bs, []) AS bs, coalesce(ns, []) AS ns
                    FROM batch LEFT JOIN (SELECT row, sum(n)::BIGINT AS n, list(bucket) AS bs, list(n) AS ns FROM counts GROUP BY row) USING (row) ORDER BY row
                """).to_arrow_table()
                columns = [found["row"], batch.column("doc_id"), *(found[c] for c in ("n_words", "n_features", "bs", "ns")), *[pa.nulls(len(batch), k) for k in _KINDS[6:]]]
                yield from _batches(columns)
            whole = db.sql("SELECT list(bucket) AS bs, list(n) AS ns FROM (SELECT bucket, sum(n)::BIGINT AS n FROM totals GROUP BY bucket)").to_arrow_table()
            yield from _batches([*[pa.nulls(1, k) for k in _KINDS[:6]], whole["bs"], whole["ns"]])

    return stage(lean(rows).mapInArrow(run, COUNTS), name)


def _batches(columns: list) -> list[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return pa.table([c.cast(k) for c, k in zip(columns, _KINDS)], names=names).combine_chunks().to_batches()


def totals(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all rows: a row for each partition and bucket is added up."""
    parts = counted.filter("total_buckets is not null").select(F.explode(F.arrays_zip("total_buckets", "total_counts")).alias("x"))
    return parts.groupBy(F.col("x.total_buckets").alias("bucket")).agg(F.sum("x.total_counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): a thousand times the logarithm of target share over source share, each count raised by one, rounded down."""
    both = source.selectExpr("bucket", "n as s", "0L as t").unionByName(target.selectExpr("bucket", "0L as s", "n as t"))
    both = both.unionByName(source.sparkSession.range(buckets).selectExpr("cast(id as int) as bucket", "0L as s", "0L as t"))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = each.agg(F.sum("s").alias("S"), F.sum("t").alias("T"))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("whole_s") + buckets) / ((d("s") + 1) * (d("whole_t") + buckets))
    return each.crossJoin(F.broadcast(whole.withColumnsRenamed({"S": "whole_s", "T": "whole_t"}))).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(seed: str, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id; a null id reads ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, min_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_features, weight, score, rank, n_words).

    ``weight`` adds up the gains of all features, runs of 1 to ``n`` words, repeats counted. Of the rows with ``min_words`` words
    or more, ``percent`` in a hundred (rounded down) are drawn, by score; equal scores: smaller ids first, null ids last.
    ``rank`` counts from 1, and is null for rows that aren't drawn. Null and empty texts have no features and weight 0. Repeated rows
    and ids are rows of their own (the same id has the same noise). Other columns are ignored, so their
    names can't clash. An empty ``target`` weighs by the corpus alone; an empty ``docs`` gives no rows.
    """
    counted = count_features(docs, n, buckets, "importance-docs", id_col, text_col)
    wanted = count_features(target.select(F.lit(None).cast("long").alias("doc_id"), target[target_col].alias("text")), n, buckets, "importance-target")
    weights = gains(totals(counted), totals(wanted), buckets)  # as many rows as buckets: a parameter
    key = ["row", "doc_id", "n_words", "n_features"]
    each = counted.filter("buckets is not null").select(*key, F.explode_outer(F.arrays_zip("buckets", "counts")).alias("x"))
    each = each.select(*key, F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n")).join(F.broadcast(weights), "bucket", "left")
    scored = each.groupBy(*key).agg(F.coalesce(F.sum(F.col("n") * F.col("gain")), F.lit(0)).cast("long").alias("weight"))
    scored = stage(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score")), "importance-scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.filter(enough).count() * percent // 100
    ranked = with_ranks(scored.filter(enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def with_ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) by ``order``: sorted by ranges, numbered in each partition, plus the rows before it."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered = stage(numbered, "importance-order")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(numbered.groupBy(part.alias("part")).count().collect())  # a row for each partition
    bases, base = [], 0
    for p, size in sizes:
        bases.append((p, base))
        base += size
    known = rows.sparkSession.createDataFrame(bases, "part long, base long")
    out = numbered.withColumn("part", part).join(F.broadcast(known), "part")
    return out.withColumn("rank", F.col("base") + within + 1).select(*rows.columns, "rank")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


OP13_SQL = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) AS r(i)
), texts AS (
  SELECT true AS ours, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS row, ours, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{FEATURE_WORD}') AS words
  FROM texts
), features AS (
  SELECT row, ours, word, count(*) AS n FROM (SELECT row, ours, unnest(words) AS word FROM numbered) GROUP BY ALL
), spelt AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM features)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, [('0x' || digits[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(digits) // 2)]),
                               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM spelt, crc_table
), dealt AS (
  SELECT row, ours, bucket, sum(n)::BIGINT AS n FROM features JOIN hashed USING (word) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t FROM dealt GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM counts) + {BUCKETS}))))::BIGINT AS gain FROM counts
), weights AS (
  SELECT row, sum(n * gain)::BIGINT AS weight FROM dealt JOIN gain USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM numbered LEFT JOIN weights USING (row) WHERE ours
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM scored
)
SELECT doc_id, n_words::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= many * 10 // 100 THEN place END AS rank, n_words::BIGINT AS n_words FROM ranked
"""
