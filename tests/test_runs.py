"""Runs that stop and go on, run records, and the history of changes."""

from __future__ import annotations

import os
from itertools import count

from pyspark.sql import functions as F
from test_operators import glossary, segs

from textloom.operators import history, review, runs, store, translate
from textloom.operators.keep import keeper
from textloom.operators.ledger import Ledger


def rows_of(spark, n=60):
    return segs(spark, [(i, i // 20, i % 20, f"段{i} {{0}}", None, "pending", "A") for i in range(n)])


def go(spark, rows, model, ledger=None, stop=lambda: False):
    cfg = translate.RunConfig("zh-CN", "en-US", "A", pause=0.0)
    g = glossary(spark, [("段", ["part"], "")]).withColumn("occurrences", F.lit(1))
    results, totals = translate.run_translation(rows, g, model, cfg, keeper(spark), ledger=ledger, stop=stop)
    return {r.id: (r.status, r.tgt_text, r.review_flag, r.cause) for r in results.collect()}, totals.first()


MODEL = {"refuse_every": 17, "omit_every": 13, "late_every": 4, "garble_every": 45, "fails_first": True}


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = rows_of(spark)
    whole, totals = go(spark, rows, translate.UnreliableModel(**MODEL))
    assert totals.status == "completed" and totals.failed == sum(v[0] == "failed" for v in whole.values()) > 0
    assert {i for i, v in whole.items() if v[0] == "failed"} == {i for i in range(60) if i % 17 == 0 or i % 13 == 0}

    ledger, turns = Ledger(f"file://{tmp_path}/ledger", size=2), count()
    part, stopped = go(spark, rows, translate.UnreliableModel(**MODEL), ledger, stop=lambda: next(turns) > 1)
    assert stopped.status == "cancelled" and 0 < sum(v[0] == "pending" for v in part.values()) < 60
    before = ledger.entries(spark).count()
    again, totals = go(spark, rows, translate.UnreliableModel(**MODEL), ledger)
    assert again == whole and totals.status == "completed"
    entries = ledger.entries(spark)
    assert entries.groupBy("stage", "req", "key").count().filter("count > 1").count() == 0 and entries.count() > before
    assert {r.attempts for r in entries.select("attempts").distinct().collect()} == {2}


def test_a_useless_answer_stops_and_stays_open(spark, tmp_path):
    rows, ledger = rows_of(spark, 40), Ledger(f"file://{tmp_path}/ledger", size=2)
    got, totals = go(spark, rows, translate.MockModel(unauthorised=True), ledger)
    assert totals.status == "paused" and {v[0] for v in got.values()} == {"pending"}
    assert 0 < ledger.entries(spark).count() < 4  # the first micro-batch, no more
    got, totals = go(spark, rows, translate.MockModel(), ledger)
    assert totals.status == "completed" and {v[0] for v in got.values()} == {"machine_translated"}


def test_run_records(spark):
    none = spark.createDataFrame([], store.RUNS)
    one, first = runs.create_run(none, "translate", 3, 10.0)
    two, second = runs.create_run(one, "induce", 5, 11.0)
    assert (first, second) == (1, 2)
    totals = spark.createDataFrame([("cancelled", 2, 1, 7, 9, 0.5)], "status string, done long, failed long, tokens_in long, tokens_out long, cost double")
    got = {r.id: r for r in runs.finish_run(two, 1, totals, 20.0, "x").collect()}
    assert (got[1].status, got[1].done, got[1].failed, got[1].tokens_out, got[1].finished_at, got[1].error) == ("cancelled", 2, 1, 9, None, "x") and got[2].status == "running"
    done = runs.finish_run(two, 1, totals.withColumn("status", F.lit("completed")), 20.0).filter("id = 1").first()
    assert done.finished_at == 20.0 and [r.id for r in runs.latest(two).collect()] == [2]


def test_history(spark):
    rows = segs(spark, [(1, 1, 0, "a", "one", "confirmed", "A"), (2, 1, 1, "b", "two", "machine_translated", "A"), (3, 1, 2, "c", None, "pending", "A")])
    state = lambda df: {r.id: (r.tgt_text, r.status) for r in df.collect()}
    log, now, seen = history.empty(spark), rows, [state(rows)]
    for old, new in (("o", "0"), ("n", "N"), ("zz", "y"), ("0", "")):
        now, changes = review.apply_preview(now, review.search_replace(now, old, new, case_sensitive=True))
        log = history.push(log, changes, old)
        seen.append(state(now))
    assert [(r.op, r.label, r.segments) for r in history.operations(log).collect()] == [(3, "0", 2), (2, "n", 1), (1, "o", 2)]  # what changed nothing is no operation
    assert state(history.as_of(now, log, 0)) == seen[0] and state(history.as_of(now, log, 1)) == seen[1] and state(history.as_of(now, log, 3)) == seen[4]
    for k in (2, 1, 0):
        now, log = history.undo_last(now, log)
        assert state(now) == seen[k]
    again, same = history.undo_last(now, log)
    assert state(again) == seen[0] and same.count() == 0


def test_undo_works_on_written_states(spark, sf_dir):
    """No step of the history repeats the steps before it, nor do the states meet in a chain of joins: what is left reads written tables."""
    from textloom.plans import state

    df = state.undo_history(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "regexp_replace" not in plan
    r = df.filter("changes = 3").first()
    assert r is None or len({r.h0, r.h1, r.h2, r.h3}) == 4 and (r.s3, r.s1) == ("human_edited", "human_edited")


def test_micro_batches_are_few_and_read_their_own_requests(spark, tmp_path, monkeypatch):
    from textloom.operators import ledger

    monkeypatch.setattr(ledger, "MOST", 3)
    requests = spark.range(250).select(F.concat(F.lit("0:"), "id").alias("req"), F.array("id").alias("ids"), F.lit("s").alias("system"), F.concat(F.lit("#"), "id", F.lit("\nx")).alias("user"))
    parts = []
    ask = lambda part: parts.append(part) or translate.ask(part.coalesce(1), translate.MockModel())
    out = Ledger(f"file://{tmp_path}/ledger", size=1).ask(requests, "a", ask, [], lambda: False)
    assert {r.req: r.answers[0].t for r in out.collect()} == {f"0:{i}": "T:x" for i in range(250)}
    files = [{r[0] for r in p.select(F.input_file_name()).distinct().collect()} for p in parts]
    assert len(parts) == 3 and not files[0] & files[1] and not files[1] & files[2] and sum(p.count() for p in parts) == 250


def test_a_model_that_fails_first_holds_no_texts():
    model = translate.UnreliableModel(fails_first=True)
    assert translate.called(model, "", "#1\n" + "x" * 9000, 1, 0)[1] == 2 and {len(m) for m in model.seen} == {16}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    import time

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    from textloom.operators.keep import RELEASE, drop

    before = files()
    kept = keeper(spark)(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7 and spark.conf.get(RELEASE, None) is None
    other, path = kept.filter("k = 1").count(), kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    drop(kept)
    assert other == 1 and not os.path.exists(path) and os.path.exists(os.path.dirname(path))


def test_requests_and_answers_are_written_once(spark, tmp_path, monkeypatch):
    """The ledger reads requests from where the run wrote them, and answers go to its table alone."""
    from textloom.operators import ledger

    written = []
    monkeypatch.setattr(ledger, "keeper", lambda s: lambda df, name, *by: written.append(name) or keeper(s)(df, name, *by))
    requests = spark.range(40).select(F.concat(F.lit("0:"), "id").alias("req"), F.array("id").alias("ids"), F.lit("s").alias("system"), F.concat(F.lit("#"), "id", F.lit("\nx")).alias("user"))
    kept = keeper(spark)(ledger.in_buckets(requests), "requests", ledger.BUCKET)
    for _ in range(2):  # the second time, all are known
        asked = []
        out = Ledger(f"file://{tmp_path}/ledger", size=20).ask(kept, "a", lambda part: asked.append(1) or translate.ask(part, translate.MockModel()), [], lambda: False)
        assert {r.req: r.answers[0].t for r in out.collect()} == {f"0:{i}": "T:x" for i in range(40)} and "user" not in out.columns
    assert written == [] and asked == [] and Ledger(f"file://{tmp_path}/ledger").entries(spark).count() == 40
