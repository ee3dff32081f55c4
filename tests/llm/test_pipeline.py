"""The stages of the pipeline, one after the other, against what each must do."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from textloom.llm import quality
from textloom.llm.common import stage


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """{stage: rows after it}, and the input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"input": docs}
    for name, f in P.STAGES:
        docs = stage(f(spark, docs, sf_dir), "test")
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_shape(steps):
    assert [n for n, _ in P.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    for name, _ in P.STAGES[:-1]:
        assert steps[name].dtypes == steps["input"].dtypes


def test_quality_stage(steps):
    kept = set(ids(steps["quality rules"]))
    for r in steps["input"].collect():
        n, *_, repeated = quality.base_counts(r.text or "")
        if quality.base_failed(n, repeated):
            assert r.doc_id not in kept


def test_exact_stage(steps):
    best = defaultdict(int)
    for r in steps["quality rules"].collect():
        best[r.text] = max(best[r.text], r.doc_id)
    assert ids(steps["exact dedup"]) == sorted(best.values())
    texts = {r.doc_id: r.text for r in steps["input"].collect()}
    assert all(texts[r.doc_id] == r.text for r in steps["exact dedup"].collect())


def test_near_stage(steps):
    """One document of each exact component at 0.8 stays, the one with the smallest id."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    before = sorted((r.doc_id, shingles(r.text)) for r in steps["exact dedup"].collect())
    root = {i: i for i, _ in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(before):
        for j, b in before[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert ids(steps["near dedup"]) == [i for i in root if root[i] == i]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and languages, an empty and a very long text, ties, repeated rows, a clashing column."""
    long = " ".join(f"w{i % 977} q{i % 613}" for i in range(30_000))
    good = " ".join(f"word{i} is here" for i in range(60))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (4, good, None), (4, good, None), (5, good + " more", "de"), (None, good + " tail", "de"), (None, "other " * 9 + good[300:], "en"), (9, "toxic", "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("__tag", F.lit(1)).withColumn("kept", F.lit("k"))


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd):
    for docs in (odd, odd.limit(0)):
        for name, step in P.STAGES[:-1]:
            out = step(spark, docs, sf_dir)
            assert out.dtypes == docs.dtypes, name
            assert not out.exceptAll(docs).count(), name
        assert {r.doc_id for r in P.packing(spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(r.text or "" for r in P.exact_duplicates(spark, odd, sf_dir).collect()) == sorted({r.text or "" for r in odd.collect()})
    assert [r.doc_id for r in P.near_duplicate_groups(spark, odd, sf_dir).filter("text like 'word%'").collect()] == [4]
    assert not P.quality_rules(spark, odd, sf_dir).filter("text is null or text = ''").count()


def test_last_stages(steps):
    left = set(ids(steps["mixing"]))
    assert left <= set(ids(steps["near dedup"]))
    pieces = steps["packing"].collect()
    assert {p.doc_id for p in pieces} == left
    length = defaultdict(int)
    for p in pieces:
        length[p.doc_id] += p.length
    assert all(length[p.doc_id] == p.doc_tokens for p in pieces)
    used = defaultdict(int)
    for p in pieces:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 2048 and np.mean(list(used.values())) > 1900


def test_exact_stage_keeps_one_of_repeated_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "n"), (None, "n")], "doc_id long, text string").withColumn("__row2", F.lit(1))
    got = P.exact_duplicates(spark, docs, sf_dir)
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, "n"), (2, "a"), (4, "")] and got.columns == docs.columns


def test_near_stage_links_by_exact_similarity(spark, sf_dir):
    """Pairs around 0.8: those just below stay, those from 0.9 on go; every removed text is in an exact component with a smaller id."""
    rows, base = [], 0
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(204)]  # 200 shingles
        near = list(words)
        for j in range(5 + k % 3 if k < 45 else 2):  # five changed words apart: 25 to 35 shingles or 10
            near[10 + 20 * j] = f"n{k}x{j}"
        rows += [(base, " ".join(words)), (base + 1, " ".join(near))]
        base += 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = set(ids(P.near_duplicate_groups(spark, docs, sf_dir)))
    # 25, 30 and 35 of 200 changed: Jaccard coefficients 0.778, 0.739 and 0.702; 10 changed: 0.905
    assert kept >= set(range(90)) and not kept & set(range(91, 120, 2))
