"""Operators on hand-made tables."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import export, memory, review, runs, segments, skew, store, terms, translate
from textloom.operators.keep import keeper
from textloom.sources.formats import parse_files, tags_of

RUBY = "array<struct<token:string,base:string,rt:string,style:string>>"


def segs(spark, rows):
    """rows: (id, doc_id, seq, src, tgt, status, cfg)."""
    df = spark.createDataFrame(rows, "id long, doc_id long, seq long, src_text string, tgt_text string, status string, cfg_hash string")
    df = df.withColumn("src_hash", T.src_hash(F.col("src_text"))).withColumn("translatable", F.lit(True)).withColumn("review_flag", F.lit(False)).withColumn("ruby_src", F.array().cast(RUBY))
    return df.withColumn("ruby_map", F.create_map().cast("map<string,string>"))


def glossary(spark, rows):
    return spark.createDataFrame([(i, s, c, n) for i, (s, c, n) in enumerate(rows)], "ord int, src string, cands array<string>, note string")


def test_memory_prefers_own_then_rank(spark):
    stored = segs(spark, [(1, 1, 0, "a", "machine", "machine_translated", "A"), (2, 2, 0, "a", "conf", "confirmed", "A"), (3, 2, 1, "b", "b2", "human_edited", "A"), (4, 3, 0, "b", "b3", "human_edited", "A"), (5, 3, 1, "c", "c3", "confirmed", "B")])
    new = stored.select("id", "doc_id", "src_text", "src_hash", "translatable").filter("doc_id in (1, 3)").union(spark.range(1).select(F.lit(9).cast("long"), F.lit(9).cast("long"), F.lit("b"), T.src_hash(F.lit("b")), F.lit(True)))
    got = {r.id: (r.tgt_text, r.status, r.cfg_hash) for r in memory.backfill(new, stored, "A").collect()}
    assert got == {1: ("machine", "machine_translated", "A"), 4: ("b3", "human_edited", "A"), 5: (None, "pending", "A"), 9: ("b2", "human_edited", "A")}
    hits = {r.id: r.tm_id for r in memory.look_up(stored.filter("doc_id = 1"), stored, "A").collect()}
    assert hits == {1: 2}


def test_deduplicate_and_batches(spark):
    rows = segs(spark, [(i, i // 30, i % 30, f"s{i % 25}" if i else "s0", None, "pending", "A") for i in range(60)])
    lead = memory.deduplicate(rows, ["doc_id", "seq"])
    assert lead.count() == 60 and lead.filter("id = lead.id").count() == 25
    got = {(r.doc_id, r.batch): r.n for r in memory.batches(rows).groupBy("doc_id", "batch").agg(F.count("*").alias("n")).collect()}
    assert got == {(d, b): 10 for d in (0, 1) for b in (0, 1, 2)}
    long = segs(spark, [(i, 1, i, "x" * 3000, None, "pending", "A") for i in range(5)])
    assert sorted(r.batch for r in memory.batches(long).collect()) == [0, 0, 1, 1, 2]


def greedy(lengths, max_segments, max_chars):
    out, batch, count, chars = [], 0, 0, 0
    for n in lengths:
        if count >= max_segments or chars >= max_chars:
            batch, count, chars = batch + 1, 0, 0
        out.append(batch)
        count, chars = count + 1, chars + n
    return out


@pytest.mark.parametrize(("max_segments", "max_chars", "parts"), [(10, 40, 7), (3, 1000, 13), (1, 5, 3), (50, 9, 31), (4, 4, 200)])
def test_batches_of_documents_over_many_blocks(spark, max_segments, max_chars, parts):
    rng = random.Random(parts)
    rows = [(d * 10_000 + k, d, k, "x" * rng.choice([0, 1, 3, 9, 30])) for d, n in enumerate([400, 1, 0, 7, 90, 2, 33]) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, doc_id long, seq long, src_text string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.batch for r in memory.batches(df, max_segments, max_chars).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for d in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == d]
        want |= dict(zip([r[0] for r in mine], greedy([len(r[3]) for r in mine], max_segments, max_chars)))
    assert got == want


def test_a_hash_in_most_rows(spark, monkeypatch):
    """Nine tenths of the rows have one hash: they are dealt out, and the rows are those of a plain join."""
    monkeypatch.setattr(skew, "SHARE", 50)
    rows = [(i, i % 50, i // 50, "hot" if i % 10 else f"h{i % 70}", True) for i in range(3000)]
    new = spark.createDataFrame([*rows, (9000, 1, 999, None, True), (9001, 1, 1000, "hot", False)], "id long, doc_id long, seq long, src_hash string, translatable boolean")
    new = new.select("*", F.lit(None).cast("string").alias("tgt_text"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("review_flag"), F.lit(None).cast("string").alias("cfg_hash"))
    stored = spark.createDataFrame([(10_000 + i, i % 45, h, "c", f"t{i}", ["confirmed", "machine_translated"][i % 2], False) for i, h in enumerate(["hot", "h0", "h10", "hot", "h0"] * 30)], "id long, doc_id long, src_hash string, cfg_hash string, tgt_text string, status string, review_flag boolean")
    assert skew.crowded(new, "src_hash").collect()[0].asDict() == {"__key": "hot", "__shares": 55}

    best = {}
    for r in stored.collect():
        key = ({"confirmed": 0, "machine_translated": 2}[r.status], r.id)
        best.setdefault(r.src_hash, {}).setdefault(r.doc_id, []).append((key, r.tgt_text, r.id))
    def other(h, doc):
        some = [min(v) for d, v in best.get(h, {}).items() if d != doc]
        return min(some)[1:] if some else (None, None)

    looked = memory.look_up(new.filter("translatable"), stored, "c")
    assert {r.id: (r.tm_text, r.tm_id) for r in looked.collect()} == {r[0]: other(r[3], r[1]) for r in [*rows, (9000, 1, 999, None, True)]}
    filled = {r.id: r.tgt_text for r in memory.backfill(new, stored, "c").collect()}
    assert filled == {r[0]: (min(best[r[3]][r[1]])[1] if r[1] in best.get(r[3], {}) else other(r[3], r[1])[0]) for r in rows} | {9000: None, 9001: None}
    led = {r.id: (r.lead.id, r.copies) for r in memory.deduplicate(new.filter("translatable"), ["doc_id", "seq"]).collect()}
    first = {h: min((r[1], r[2], r[0]) for r in rows if r[3] == h)[2] for h in {r[3] for r in rows}}
    assert led == {r[0]: (first[r[3]], sum(x[3] == r[3] for x in rows)) for r in rows}


def test_context(spark):
    rows = segs(spark, [(i, 1, i, f"S{i}", f"T{i}" if i in (0, 2, 3) else None, "confirmed" if i in (0, 2, 3) else "pending", "A") for i in range(6)])
    got = {r.id: (r.before, r.after) for r in memory.context(rows, 2).collect()}
    assert got[0] == ([], ["S1", "S2"]) and got[3] == (["T0", "T2"], ["S4", "S5"]) and got[5] == (["T2", "T3"], [])
    b, a = memory.cap_context(F.array(F.lit("x" * 8), F.lit("y" * 4)), F.array(F.lit("z" * 4), F.lit("w" * 9)), 10)
    row = spark.range(1).select(b.alias("b"), a.alias("a")).first()
    assert row.b == [] and row.a == ["zzzz"]


def test_consistency_and_issues(spark):
    rows = segs(spark, [(1, 1, 0, "灵石闪光。", "The Spirit Stones glow.", "confirmed", "A"), (2, 1, 1, "丹炉冒烟。", "It smokes.", "machine_translated", "A")])
    g = glossary(spark, [("灵石", ["spirit stone"], ""), ("丹炉", ["furnace"], ""), ("剑", ["sword"], "")])
    got = [(r.src, r.src_hits, r.candidate_hits, r.status, r.suspicious) for r in terms.consistency(rows, g).collect()]
    assert got == [("丹炉", 1, 0, "missing", [2]), ("灵石", 1, 1, "ok", []), ("剑", 0, 0, "ok", [])]
    found = terms.issues(rows, [("灵石", ["mana stone"]), ("丹炉", ["furnace"])], {"灵石": ["Spirit Stone", "mana stone"]})
    assert [[(i.kind, i.term, i.old) for i in r.issues] for r in found.orderBy("id").collect()] == [[("old", "灵石", "Spirit Stone")], [("missing", "丹炉", "")]]


def test_many_terms_split_over_automata(spark, monkeypatch):
    rows = segs(spark, [(i, 1, i, f"w{i} abc{i % 7}x y" if i % 9 else None, None, "pending", "A") for i in range(40)])
    g = glossary(spark, [(f"c{i}x", ["q"], "") for i in range(9)] + [("y", ["q"], ""), ("", ["q"], ""), ("y", ["r"], "")])
    key = lambda d: sorted((r.id, r.src, r.cands[0]) for r in d.collect())
    one = key(terms.containing(rows, g, "src_text"))
    monkeypatch.setattr(terms, "AUTOMATON_CHARS", 7)
    monkeypatch.setattr(terms, "BROADCAST_BYTES", 0)
    assert len(terms.automata(g.select("src"))) > 3 and key(terms.containing(rows, g, "src_text")) == one
    assert one == sorted((r.id, t.src, t.cands[0]) for r in rows.collect() for t in g.collect() if t.src and r.src_text and t.src in r.src_text)
    assert terms.containing(rows, g.limit(0), "src_text").count() == 0


def test_a_term_in_every_segment(spark):
    """Suspicious segments are the first fifty by document and place, whatever the partitions; nothing but a row a term and partition is shuffled."""
    n = 3000
    rows = spark.range(n).selectExpr("(id * 7919) % 3000 as id", "id % 13 as doc_id", "id as seq", "'the cat ' || id as src_text", "if(id % 3 = 0, 'la chat', 'x Chats chat') as tgt_text", "'confirmed' as status", "true as translatable").repartition(7)
    g = glossary(spark, [("the", ["chat"], ""), ("cat", ["none"], ""), ("cat", ["x"], ""), ("qq", ["x"], "")])
    got = {r.src + r.candidates: r for r in terms.consistency(rows, g, keep=50).collect()}
    want = [r.id for r in rows.orderBy("doc_id", "seq").collect()]
    assert (got["thechat"].src_hits, got["thechat"].candidate_hits, got["thechat"].suspicious) == (n, n // 3 + 4 * n // 3, [])
    assert (got["catnone"].src_hits, got["catnone"].candidate_hits, got["catnone"].suspicious) == (n, 0, want[:50])
    third = [r.id for r in rows.filter("seq % 3 = 0").orderBy("doc_id", "seq").collect()]
    assert got["catx"].suspicious == third[:50] and got["qqx"].src_hits == 0


def test_impact_replace_undo(spark):
    rows = segs(spark, [(1, 1, 0, "灵石亮", "mana stone, es", "confirmed", "A"), (2, 1, 1, "灵石换丹", "pill", "machine_translated", "A"), (3, 1, 2, "无", "mana stone", "pending", "A")])
    old, new = glossary(spark, [("灵石", ["mana stone"], ""), ("同", ["es"], "")]), glossary(spark, [("灵石", ["spirit stone"], ""), ("同", ["EST"], "")])
    hit = terms.impact(rows, terms.snapshot_diff(old, new))
    got = sorted((r.seg_id, r.kind, r.term, r.old, r.new) for r in hit.collect())
    assert got == [(1, "old", "同", "es", "EST"), (1, "old", "灵石", "mana stone", "spirit stone"), (2, "missing", "灵石", "", "spirit stone"), (3, "old", "灵石", "mana stone", "spirit stone")]
    after, changes = terms.replace_all(rows, hit)
    assert {r.id: (r.tgt_text, r.status) for r in after.collect()} == {1: ("spirit stone, EST", "human_edited"), 2: ("pill", "machine_translated"), 3: ("spirit stone", "human_edited")}
    back = terms.undo(after, changes)
    assert sorted(map(tuple, back.select("id", "tgt_text", "status").collect())) == sorted(map(tuple, rows.select("id", "tgt_text", "status").collect()))
    assert {r.id for r in terms.mark(rows, hit).filter("status = 'pending'").collect()} == {1, 2, 3}


def test_glossary_changes(spark):
    g = glossary(spark, [("a", ["x"], ""), ("b", ["y"], "n")])
    assert [r.cands for r in terms.add_term(g, " a ", ["p|q", "r", "s"]).orderBy("ord").collect()] == [["p", "q", "r"], ["y"]]
    assert [r.src for r in terms.add_term(g, "c", ["z"]).orderBy("ord").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        terms.add_term(g, "d", [" "])
    merged = terms.merge_glossary(g, glossary(spark, [("b", ["no"], ""), ("c", ["1"], ""), ("c", ["2"], "")]))
    assert [(r.src, r.cands) for r in merged.orderBy("ord").collect()] == [("a", ["x"]), ("b", ["y"]), ("c", ["1"])]
    h = lambda d: terms.effective_hash(d).first()[0]
    assert h(g) == h(g.withColumn("note", F.lit("other")).withColumn("ord", -F.col("ord"))) != h(terms.remove_term(g, "a"))
    revisions = spark.createDataFrame([], store.REVISIONS)
    payload = spark.createDataFrame([('[{"src":"a","candidates":["x"],"note":""}]',)], "payload string")
    once = terms.snapshot(revisions, payload, 1.0)
    twice = terms.snapshot(once, payload, 2.0)
    assert once.count() == twice.count() == 1
    third = terms.snapshot(once, payload.withColumn("payload", F.lit("[]")), 3.0)
    assert [r.src for r in terms.previous_state(third, g).collect()] == ["a"]


def test_induction_counts(spark):
    docs = spark.createDataFrame([(1, "林凡。握着", False), (2, "灵石。灵石", False)], "id long, text string, terms_extracted boolean")
    got = {r.word: r.n for r in terms.candidate_words(docs, "zh", least=1, order="id").collect()}
    assert got["灵石"] == 2 and got["凡握"] == 1
    assert [r.word for r in terms.bridging_bigrams(docs, order="id").collect()] == ["着灵"]
    en = spark.createDataFrame([(1, "Eldric raised the runestone. " * 5, False)], "id long, text string, terms_extracted boolean")
    out = translate.induce_terms(en, glossary(spark, [("Eldric", ["x"], "")]), translate.MockModel(), "en", keeper(spark))
    assert sorted((r.src, r.cands, r.occurrences) for r in out.collect()) == [("raised", ["RAISED"], 5), ("runestone", ["RUNESTONE"], 5)]


def test_states(spark):
    rows = segs(spark, [(1, 1, 0, "a", "\t", "human_edited", "A"), (2, 1, 1, "b", "B", "machine_translated", "B"), (3, 2, 0, "c", None, "pending", None), (4, 2, 1, "d", "D", "confirmed", "A")])
    assert {r.status for r in review.confirm(rows).filter("id in (2, 4)").collect()} == {"confirmed"} and review.confirm(rows).filter("id = 1").first().status == "human_edited"
    assert rows.filter(segments.confirmable_stored()).count() == 2 and rows.filter(segments.confirmable()).count() == 1
    assert [r.id for r in review.mark_stale(rows, "A").filter("status = 'pending'").orderBy("id").collect()] == [2, 3]
    e = review.edit(rows, 3, "C").filter("id = 3").first()
    assert (e.tgt_text, e.status) == ("C", "human_edited")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r.id: r.state for r in segments.document_states(docs, rows).collect()} == {1: "已翻译待校对 2/2", 2: "翻译中 1/2", 3: "无内容"}
    assert segments.confirm_block_reason(rows).first().asDict() == {"blank": 2, "confirmed": 1}
    assert [r.id for r in segments.in_document_order(rows, [2, 1]).collect()] == [3, 4, 1, 2]
    assert [r.id for r in segments.list_segments(rows, search="%b").collect()] == [2]
    moved = store.with_source(rows, F.col("id") == 1, F.lit("new")).filter("id = 1").first()
    assert moved.review_flag and moved.src_text == "new"
    assert segments.import_counts(rows).filter("doc_id = 1").first().reused == 2


def test_search_replace(spark):
    rows = segs(spark, [(1, 1, 0, "a", "The the THE", "confirmed", "A"), (2, 1, 1, "b", None, "pending", "A"), (3, 1, 2, "c", "a.b $1", "confirmed", "A")])
    assert [(r.id, r.after, r.n) for r in review.search_replace(rows, "the", "x").collect()] == [(1, "x x x", 3)]
    assert [r.after for r in review.search_replace(rows, "a.b", r"<\g<0>>$").collect()] == ["<a.b>$ $1"]
    assert [r.after for r in review.search_replace(rows, r"(t)(h)", r"\2\1", regex=True, case_sensitive=True).collect()] == ["The hte THE"]
    after, changes = review.apply_preview(rows, review.search_replace(rows, "the", "x"))
    assert after.filter("id = 1").first().tgt_text == "x x x" and terms.undo(after, changes).filter("id = 1").first().tgt_text == "The the THE"


def test_store(spark):
    docs = spark.createDataFrame([(1, "a", "txt", "h1", {"k": "v"}, True, "exported")], store.DOCUMENTS)
    new = spark.createDataFrame([("a", "txt", "h2"), ("c", "md", "h"), ("b", "md", "h")], "path string, format string, content_hash string")
    out = {r.path: (r.id, r.content_hash, r.terms_extracted, dict(r.tags)) for r in store.upsert_documents(docs, new).collect()}
    assert out == {"a": (1, "h2", False, {"k": "v"}), "b": (2, "h", False, {}), "c": (3, "h", False, {})}
    old = spark.createDataFrame([(1, 1, 0, "x")], "id long, doc_id long, seq long, src_text string")
    assert store.migrate(old, store.SEGMENTS).columns[-1] == "ruby_src"
    changed = store.update(docs, spark.createDataFrame([(1, None, "done")], "id long, format string, status string"), "id").first()
    assert (changed.format, changed.status) == ("txt", "done")
    gone_d, gone_s = store.delete_documents(docs, segs(spark, [(1, 1, 0, "a", None, "pending", "A")]), spark.createDataFrame([(1,)], "id long"))
    assert gone_d.count() == gone_s.count() == 0
    assert store.config_hash("a", "", "en", "t") == store.config_hash("a", "", "en", "t", None) != store.config_hash("a", "", "en", "t", "keep")


def test_runs(spark):
    docs = spark.createDataFrame([(1, '{"a":"1","b":""}'), (2, '{"a":"2"}'), (3, "bad")], "id long, j string").select("id", tags_of(F.col("j")).alias("tags"))
    assert [tuple(r) for r in runs.union_tags(docs).collect()] == [("a", "2")]
    urls = spark.createDataFrame([("http://127.0.0.1:1/v1",), ("http://box.local",), ("https://api.anthropic.com",), ("http://10.1.2.3",)], "u string")
    assert [tuple(r) for r in urls.select(runs.is_local_url(F.col("u")), runs.provider_type(F.col("u"))).collect()] == [(True, "openai"), (True, "openai"), (False, "anthropic"), (True, "openai")]
    cache = spark.createDataFrame([("p", 0.0, ["b", "a", "b"]), ("q", 100000.0, ["c"])], "provider string, saved_at double, models array<string>")
    assert [(r.provider, r.models) for r in runs.fresh_models(cache, 100001.0).collect()] == [("q", ["c"])]


def test_parse_responses():
    ok = '{"translations":[{"id":"1","t":"a","ruby":{"r0":"x","{r1}":" "}},{"id":7,"t":"no"},{"id":"q"}]}'
    assert translate.parse_translations(ok, [1, 2]) == ({1: "a"}, {1: {"{r0}": "x"}})
    assert translate.parse_translations("```json\n" + ok + "\n```", [1])[0] == {1: "a"}
    assert translate.parse_translations('"id": 2, "t": "broken \\u4e2d" ...', [2])[0] == {2: "broken 中"}
    with pytest.raises(translate.ResponseFormatError):
        translate.parse_translations("garbage", [1])
    assert translate.parse_terms('[{"src":" a ","candidates":["1","","2","3","4"],"note":" n "},{"src":"b","candidates":[]}]') == [("a", ["1", "2", "3"], "n")]


def test_settle_readings():
    e = [{"token": "{r0}", "rt": "かずひろ"}, {"token": "{r1}", "rt": "まほう"}]
    assert translate.settle_readings("A{r0}B{r1}", e, {}, "keep") == ("A{r0}B{r1}", {}, False)
    assert translate.settle_readings("A{r0}B", e, {}, "keep") == ("A{r0}B《まほう》", {}, True)
    assert translate.settle_readings("A{r0}{r0}{r1}{r9}", e, {}, "keep") == ("A{r0}{r1}", {}, True)
    assert translate.settle_readings("A{r0}{r1}", e, {"{r0}": "K"}, "translate") == ("A{r0}{r1}", {"{r0}": "K"}, True)
    assert translate.settle_readings("A{r0} 。", e, {}, "drop") == ("A。", {}, True)
    assert translate.settle_readings("A{r0}", [], {}, "keep") == ("A", {}, True)


def run(spark, rows, model, **kw):
    cfg = translate.RunConfig("zh-CN", "en-US", "A", **kw)
    g = glossary(spark, [("灵石", ["spirit stone"], "")]).withColumn("occurrences", F.lit(1))
    results, totals = translate.run_translation(rows, g, model, cfg, keeper(spark))
    return {r.id: (r.status, r.tgt_text, r.review_flag, r.cause) for r in results.collect()}, totals.first()


def test_translation_run(spark):
    rows = segs(spark, [(1, 1, 0, "共享", None, "pending", "A"), (2, 2, 0, "共享", None, "pending", "A"), (3, 1, 1, "　", None, "pending", "A"), (4, 1, 2, "旧", None, "failed", "A"), (5, 3, 0, "旧", "old", "confirmed", "A"), (6, 2, 1, "灵石{0}", None, "pending", "A"), (7, 2, 2, "拒绝", None, "pending", "A"), (8, 3, 1, "漏", None, "pending", "A")])
    got, totals = run(spark, rows, translate.MockModel(terms={"灵石": "spirit stone"}, refuse=frozenset({7}), omit=frozenset({8})))
    assert got[1][:3] == got[2][:3] == ("machine_translated", "T:共享", False) and got[3][:2] == ("machine_translated", "") and got[4] == ("confirmed", "old", False, "memory")
    assert got[6][:2] == ("machine_translated", "T:spirit stone{0}")
    assert got[7] == ("failed", None, False, "single:ContentPolicyError") and got[8][0] == "failed"
    assert (totals.total, totals.done, totals.failed, totals.tm, totals.status) == (7, 5, 2, 1, "completed") and totals.tokens_in > 0
    assert len(got) == totals.total == totals.done + totals.failed


def test_fatal_error_pauses(spark):
    rows = segs(spark, [(i, 1, i, f"段{i}", None, "pending", "A") for i in range(3)])
    got, totals = run(spark, rows, translate.MockModel(unauthorised=True))
    assert {v[0] for v in got.values()} == {"pending"} and totals.status == "paused"


def test_apply_results(spark):
    rows = segs(spark, [(1, 1, 0, "a", None, "pending", None), (2, 1, 1, "b", "B", "confirmed", "A")])
    results = spark.createDataFrame([(1, "machine_translated", "T:a", True, {"{r0}": "x"}, None)], "id long, status string, tgt_text string, review_flag boolean, ruby_map map<string,string>, cause string")
    got = {r.id: (r.tgt_text, r.status, r.review_flag, r.cfg_hash) for r in translate.apply_results(rows, results, "N").collect()}
    assert got == {1: ("T:a", "machine_translated", True, "N"), 2: ("B", "confirmed", False, "A")}


def test_export_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("eins\nzwei\n")
    (src / "b.md").write_text("# Kopf\n\ntext `c`\n")
    files = spark.read.format("binaryFile").load(str(src)).select("path", "content")
    blocks = parse_files(files)
    docs = blocks.select("path", "format", "content_hash").distinct().withColumn("id", F.when(F.col("format") == "txt", 1).otherwise(2).cast("long")).withColumn("tags", F.create_map().cast("map<string,string>"))
    table = blocks.join(docs.select("path", F.col("id").alias("doc_id")), "path").withColumn("tgt_text", F.when(F.col("translatable"), F.concat(F.lit("T:"), "src_text"))).withColumn("status", F.lit("confirmed")).withColumn("ruby_map", F.create_map().cast("map<string,string>"))
    out = str(tmp_path / "out")
    go = lambda **kw: {r.doc_id: r for r in export.export_files(files, docs, table, out, "en-US", **kw).collect()}
    first = go()
    assert first[1].ok and first[2].ok
    assert open(first[1].out_path).read() == "T:eins\nT:zwei\n" and first[1].out_path.endswith("a.en.txt")
    assert open(first[2].out_path).read() == "T:# Kopf\n\nT:text `c`\n"
    assert go(on_conflict="keep_both")[1].out_path.endswith("a.en(2).txt") and not go(on_conflict="skip")[1].ok
    html = go(output="html")[2]
    assert open(html.out_path).read() == "<html><body><h1>T:Kopf</h1><p>T:text `c`</p></body></html>"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.en(2).txt", "a.en.html", "a.en.txt", "b.en(2).md", "b.en.html", "b.en.md"]
    uri = {r.doc_id: r for r in export.export_files(files, docs, table, f"file://{tmp_path}/other", "en-US").collect()}
    assert uri[1].ok and (tmp_path / "other" / "a.en.txt").read_text() == "T:eins\nT:zwei\n"
    changed = {r.doc_id: r for r in export.export_files(files, docs.withColumn("content_hash", F.lit("x")), table, out, "en-US").collect()}
    assert not changed[1].ok and "changed" in changed[1].warnings[-1]


@pytest.mark.parametrize("rule", ["overwrite", "skip", "keep_both"])
def test_names_are_dealt_before_writing(spark, rule):
    """Against documents one after the other; for keep_both, wanted names count as taken from the begin."""
    wanted = [(i, n) for i, n in enumerate(["a.txt", "b.md", "a.txt", "a(2).txt", "a.txt", "c", "c", "(2)", "a.txt", "b.md", "x(3).y.md", "x.y.md", "x.y.md"])]
    there = ["a.txt", "a(3).txt", "a(4).txt", "c(2)", "x.y.md", "a(02).txt", "z"]
    got = {r.doc_id: r.name for r in export.deal_names(spark.createDataFrame(wanted, "doc_id long, name string").repartition(4), spark.createDataFrame([(t,) for t in there], "name string"), rule).collect()}
    taken, want = set(there), {}
    for i, n in wanted:
        last = max(k for k, m in wanted if m == n)
        if rule == "overwrite":
            want[i] = n if i == last else None
        elif rule == "skip":
            want[i] = None if n in taken else n
            taken.add(n)
        else:
            name, k = n, 1
            stem, ext = re.fullmatch(r"(.+?)((?:\.[^.]*)?)", n).groups()
            free = lambda x, n=n: x not in taken and (x == n or x not in {m for _, m in wanted})  # noqa: E731, B023
            while not free(name):
                k += 1
                name = f"{stem}({k}){ext}"
            want[i] = name
            taken.add(name)
    assert got == want


def test_progress_stream(spark, tmp_path):
    from textloom.streaming.progress import progress_totals

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "done", 5, 2), (1, "failed", 1, 1), (2, "done", 3, 3)], "run_id long, status string, tokens_in long, tokens_out long").write.mode("append").parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema("run_id long, status string, tokens_in long, tokens_out long").parquet(str(tmp_path / "in" / "p"))
    q = progress_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == [(1, 2, 1, 1, 6, 3), (2, 1, 1, 0, 3, 3)]


def test_numbers_are_gapless_at_size(spark):
    """Many rows of uneven width: every row keeps its place, with adaptive execution and without."""
    from textloom.operators.store import numbered

    wide = F.repeat(F.lit("x"), (F.col("id") % 97 == 0).cast("int") * 400 + 1)
    rows = spark.range(0, 200_000, 1, 7).select(((F.col("id") * 7919) % 200_003).alias("k"), wide.alias("payload"))
    for on in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", on)
        out = numbered(rows, ["k"], "n")
        checks = out.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.sum("n")).first()
        assert tuple(checks) == (200_000, 200_000, 1, 200_000, 200_000 * 200_001 // 2)
        a, b = out.alias("a"), out.alias("b")
        assert not a.join(b, F.col("a.n") + 1 == F.col("b.n")).filter("a.k >= b.k").count()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_candidates_level_with_the_last_one(spark):
    """Counts and first documents alone don't decide which words are among the top; places do, and a document without an id comes first."""
    rows = [(3, "dddd cccc bbbb aaaa aaaa"), (1, "zzzz yyyy xxxx wwww"), (1, "wwww xxxx yyyy zzzz"), (5, "dddd cccc bbbb"), (None, "yyyy vvvv"), (None, "vvvv uuuu uuuu"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every = {}
    for d, t in rows:
        for p, w in enumerate((t or "").split()):
            every.setdefault(w, []).append(((d is not None, d or 0), p))
    ranked = sorted((-len(at), min(at), w) for w, at in every.items() if len(at) >= 2)
    for top in range(1, len(ranked) + 2):
        got = terms.candidate_words(docs, top=top).collect()
        assert [(r.word, r.n, r.first[0] or 0, r.first[1]) for r in got] == [(w, -n, d[1], p) for n, (d, p), w in ranked[:top]]
    steps = []
    keep = terms.keeper(spark)
    mp = pytest.MonkeyPatch()
    mp.setattr(terms, "keeper", lambda _: lambda df, name: steps.append(df) or keep(df, name))
    terms.candidate_words(docs)
    mp.undo()
    assert "SortAggregate" not in steps[0]._jdf.queryExecution().sparkPlan().toString()


def test_context_by_ids(spark):
    """Ids of neighbours stand for the texts that ``context`` gives, over documents in all states."""
    rng, states = random.Random(3), ["pending", "failed", "machine_translated", "confirmed"]
    rows = segs(spark, [(i, i % 3, i // 3, f"s{i}", f"t{i}" if rng.random() < 0.8 else None, rng.choice(states), "A") for i in range(60)])
    src, tgt = ({r.id: r[c] for r in rows.collect()} for c in ("src_text", "tgt_text"))
    for n in (0, 1, 3):
        want = {r.id: (r.before, r.after) for r in memory.context(rows, n).collect()}
        got = {r.id: ([tgt[i] for i in r.above], [src[i] for i in r.below]) for r in memory.neighbours(rows, n).collect()}
        assert got == want


def test_a_run_moves_ids_before_texts(spark):
    """Memory and copies are worked out without texts, requests share one shuffle of them, and what a run has read for the last time is removed."""
    kept = {}
    rows = segs(spark, [(i, i // 8, i % 8, f"段{i % 9}", f"t{i}" if i % 5 == 0 else None, "confirmed" if i % 5 == 0 else "pending", "A") for i in range(24)])
    g = glossary(spark, [("段", ["part"], "")]).withColumn("occurrences", F.lit(1))
    write = keeper(spark)

    def keep(df, name, *by):
        kept[name] = write(df, name, *by)
        folders[name] = kept[name].inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        return kept[name]

    folders = {}
    cfg = translate.RunConfig("zh-CN", "en-US", "A")
    results, totals = translate.run_translation(rows, g, translate.MockModel(), cfg, keep)
    assert {c for n in ("memory", "hits", "leads") for c, kind in kept[n].dtypes if kind == "string"} <= {"src_hash", "tm_status"}
    assert {n for n, f in folders.items() if os.path.exists(f)} == {"results", "totals"} and totals.first().total == results.count() == 19
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    todo = rows.filter("status = 'pending'").select("id", "doc_id", "seq", F.length("src_text").alias("n"), F.lit(False).alias("copied"))
    plan = translate.requests_for(todo, rows, g, None, cfg)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and plan.count("partial_collect_list") == 2  # of the parts and of the terms
