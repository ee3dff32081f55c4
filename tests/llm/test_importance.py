"""Importance resampling against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def features(text, n, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute(rows, target, percent, min_words=20, n=1, buckets=10_000, seed="2024"):
    found = [(i, *features(t, n, buckets)) for i, t in rows]
    s, t = Counter(b for *_, bs in found for b in bs), Counter(b for x in target for b in features(x, n, buckets)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, bs in found:
        weight = sum(gain[b] for b in bs)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in out), key=str)


def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeABÉéß日0 ,.\x00\x7f") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "  ..  "), (None, "word " * 40), (None, None), (1003, "same " * 30), (1003, "same " * 30), (1004, "long text " * 60_000)]
    return rows


TARGET = ["same word again", None, "", "long É日 target é", "A0 b"]


@pytest.mark.parametrize("n", [1, 3])
def test_odd_rows(spark, n):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row int, bucket string, n int").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(docs, target, percent=30, n=n, buckets=97)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET, 30, n=n, buckets=97)


def test_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(docs.limit(0), target, percent=10).collect() == []
    got = importance.resample(docs, target.limit(0), percent=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(odd_rows(), [], 10)


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = importance.with_ranks(rows, [F.desc("score"), F.asc_nulls_last("doc_id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.doc_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(i, k + 1) for k, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 7), i)))]


def test_query_against_brute_force_and_sql(spark, sf_dir):
    df = importance.op13_importance(spark, sf_dir)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got == brute(rows, target, 10)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert got == sorted(con.sql(importance.OP13_SQL).select(", ".join(df.columns)).fetchall(), key=str)
