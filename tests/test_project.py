"""Settings, lock, approval, rewriting rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import project as P
from textloom.operators import store


def test_project_and_settings(tmp_path):
    p = P.Project("n", "ja-JP", "en-US")
    p.save(str(tmp_path / "p.json"))
    assert P.Project.load(str(tmp_path / "p.json")) == p and p.slide() == 2 and p.change(context_slide=9).slide() == 5
    assert p.hash("t") == p.change(src_lang="zh", model="m").hash("t") != p.change(ruby_policy="drop").hash("t")
    s = P.Settings.load(str(tmp_path / "none.json"))
    for x in ("a", "b", "a"):
        s.add_recent(x)
    assert s.recent_projects == ["a", "b"] and s.concurrency == 4
    s.save(str(tmp_path / "s.json"))
    assert P.Settings.load(str(tmp_path / "s.json")) == s
    with pytest.raises(KeyError):
        s.provider("x")
    with P.lock(str(tmp_path)), pytest.raises(P.LockedError):
        with P.lock(str(tmp_path)):
            pass


def test_language_and_rules(spark):
    df = spark.createDataFrame([("JA_jp",), ("zh",), ("xx",)], "c string")
    assert [r[0] for r in df.select(P.normalize_language(F.col("c"))).collect()] == ["ja-JP", "zh-CN", "xx"]
    df = spark.createDataFrame([("已完成 3 段",), ("取消",), ("other",)], "t string")
    out = df.select(P.rewrite(F.col("t"), {"取消": "Cancel"}, [(r"^已完成 (\d+) 段$", "$1 done"), (r"^(\d) done$", "[$1]")]))
    assert [r[0] for r in out.collect()] == ["[3]", "Cancel", "other"]


def test_approve_reject(spark):
    cache = spark.createDataFrame([(0, "a", ["x"], "", "ai_induced", "candidate", 3), (1, "b", ["y"], "", "ai_induced", "candidate", 2)], store.TERMS)
    terms = spark.createDataFrame([(0, "b", ["own"], "")], "ord int, src string, cands array<string>, note string")
    new, glossary = P.approve(cache, terms, cache.select("src"))
    assert {r.status for r in new.collect()} == {"approved"} and {(r.src, r.cands[0]) for r in glossary.collect()} == {("a", "x"), ("b", "own")}
    assert {r.src: r.status for r in P.reject(cache, cache.filter("src = 'a'")).collect()} == {"a": "rejected", "b": "candidate"}
