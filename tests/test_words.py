"""Chinese words: paths against brute force, and learning on texts made of known words."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions.automaton import Automaton
from textloom.functions.lattice import cut_words, pieces
from textloom.operators import terms, words

LEXICON = ["灵石", "丹炉", "剑", "功法", "天地玄黄", "宗门", "师兄", "运转", "丹田", "飞"]


def best_path(run, score, unknown):
    best = [(0, 0, [])]
    for t in range(1, len(run) + 1):
        ways = [(best[t - n][0] + score[run[t - n : t]], n) for n in range(1, t + 1) if run[t - n : t] in score]
        s, n = max([*ways, (best[t - 1][0] + unknown, 1)])
        best.append((s, n, [*best[t - n][2], run[t - n : t]]))
    return best[-1][2]


@pytest.mark.parametrize("parts", [1, 3])
def test_paths_against_brute_force(parts):
    rng = random.Random(parts)
    for _ in range(250):
        letters = "天地玄黄"[: rng.randint(1, 4)]
        score = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(rng.randint(0, 12))}
        texts = ["".join(rng.choice(letters * 2 + "x 日") for _ in range(rng.randint(0, 40))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 9))]
        shards = [{w: s for k, (w, s) in enumerate(sorted(score.items())) if k % parts == i} for i in range(parts)]
        automata = [(a, np.array([d[w] for w in a.words], dtype=np.int64)) for d in shards for a in [Automaton(list(d))]]
        want = [[w for run in re.findall("[一-鿿]+", t or "") for w in best_path(run, score, -9)] for t in texts]
        assert cut_words(pa.array(texts, pa.string()), automata, -9).to_pylist() == want


def corpus(n=400):
    rng = random.Random(8)
    return [(i, "，".join("".join(rng.choice(LEXICON) for _ in range(rng.randint(1, 7))) for _ in range(4)) + "。x{r1}") for i in range(n)]


def test_learnt_words(spark):
    docs = spark.createDataFrame([*corpus(), (1000, None), (1001, ""), (1002, "no Han")], "doc_id long, text string").repartition(3)
    learnt = words.learn_words(docs, cohesion=1.5)
    known = {r.word: r.n for r in learnt.collect()}
    whole = [w for w in LEXICON if len(w) > 1]
    assert set(whole) <= set(known) and all(known[w] == sum(t.count(w) for _, t in corpus()) for w in whole)
    assert {w for w in known if len(w) > 1} - set(whole) <= {"玄黄", "天地"}  # parts of a word aren't free
    got = {r.word: r.n for r in terms.candidate_words(docs, "zh", dictionary=learnt).collect()}
    assert got == {w: known[w] for w in whole}


def test_dictionary_in_several_automata(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "一个" + t) for i, t in corpus(60)], "doc_id long, text string")
    known = spark.createDataFrame([(w, -k) for k, w in enumerate(["灵石", "丹炉", "剑灵", "石丹", "功法", "一个"])], "word string, score long")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    one = key(words.chinese_words(docs, known))
    monkeypatch.setattr(words, "AUTOMATON_CHARS", 4)
    assert key(words.chinese_words(docs, known)) == one and one and not any(r[2] == "一个" for r in one)
    monkeypatch.setattr(words, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        words.cutter(known)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert words.learn_words(none).count() == words.chinese_words(none).count() == 0
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("灵石飞"), 20_000).alias("text"))
    known = spark.createDataFrame([("灵石", -1), ("飞", -1)], "word string, score long")
    assert words.chinese_words(long, known).count() == 20_000


def test_cutting_holds_little_beside_its_batch():
    import tracemalloc

    known = Automaton(["灵石", "丹炉", "功法"])
    texts = pa.array([t * 12 for _, t in corpus(8000)], pa.string())  # as a batch of a task
    tracemalloc.start()
    found = sum(len(w) for p in pieces(texts) for w in [cut_words(p, [(known, np.zeros(3, dtype=np.int64))], -9)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 8000 and peak < 60 << 20
    assert [len(p) for p in pieces(pa.array(["a" * 9, None, "", "b", "c" * 2], pa.string()), 3)] == [1, 4] and pieces(pa.array([], pa.string())) == []


def test_equal_stretches_are_learnt_from_once(spark, monkeypatch):
    kept = []
    keep = words.keeper(spark)
    monkeypatch.setattr(words, "keeper", lambda _: lambda df, name: kept.append(df) or keep(df, name))
    words.learn_words(spark.createDataFrame([(i, "灵石，丹炉") for i in range(50)], "doc_id long, text string"))
    plan = kept[0]._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate explode") < plan.rindex("Aggregate [s#")  # grams are made of counted stretches
