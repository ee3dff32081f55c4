"""Queries over states: memory, deduplication, batches, review, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import memory, review, runs, segments as segs, translate
from textloom.plans.base import SEGMENTS, STRIP, segments, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "c1"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TODO = f"{SEGMENTS}, todo AS (SELECT * FROM seg WHERE translatable AND status = 'pending')"
RANKED = f"""{TODO}, stored AS (SELECT src_hash, doc_id, id, tgt_text, status, cfg_hash, CASE status WHEN 'confirmed' THEN 0 WHEN 'human_edited' THEN 1 WHEN 'machine_translated' THEN 2 END AS rk FROM seg WHERE status <> 'pending' AND tgt_text <> '' AND cfg_hash = '{NOW}')"""


def todo(spark, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).filter("translatable and status = 'pending'")


@query(f"WITH {TODO} SELECT id, first_value(id) OVER (PARTITION BY src_hash ORDER BY doc_id, seq, id) AS lead_id, count(*) OVER (PARTITION BY src_hash) AS copies FROM todo")
def dedup_fanout(spark, sf_dir: str) -> DataFrame:
    """For each pending segment, the one that is translated for it."""
    return memory.deduplicate(todo(spark, sf_dir), ["doc_id", "seq"]).select("id", F.col("lead.id").alias("lead_id"), "copies")


@query(f"WITH {TODO} SELECT id, doc_id, seq, src_hash FROM (SELECT *, row_number() OVER (PARTITION BY src_hash ORDER BY doc_id, seq, id) AS k FROM todo) WHERE k = 1")
def dedup_first(spark, sf_dir: str) -> DataFrame:
    out = memory.deduplicate(todo(spark, sf_dir), ["doc_id", "seq"]).filter("id = lead.id")
    return out.select("id", "doc_id", "seq", "src_hash")


@query(f"""WITH {RANKED}, best AS (SELECT src_hash, doc_id, min((rk, id)) AS b FROM stored GROUP BY ALL)
SELECT t.id, CASE WHEN min(b.b) IS NULL THEN NULL ELSE struct_extract(min(b.b), 2) END AS tm_id, first(t.src_text) IS NOT NULL AS known FROM todo t LEFT JOIN best b ON b.src_hash = t.src_hash AND b.doc_id <> t.doc_id GROUP BY t.id""")
def tm_lookup(spark, sf_dir: str) -> DataFrame:
    """The memory hit of each pending segment in another document."""
    s = segments(spark, sf_dir)
    out = memory.look_up(s.filter("translatable and status = 'pending'"), s, NOW)
    return out.select("id", "tm_id", F.lit(True).alias("known"))


@query(f"""WITH {SEGMENTS}, stored AS (SELECT src_hash, doc_id, id, CASE status WHEN 'confirmed' THEN 0 ELSE 2 END AS rk, status FROM seg WHERE status <> 'pending' AND tgt_text IS NOT NULL AND cfg_hash = '{NOW}'),
own AS (SELECT src_hash, doc_id, min((rk, id, status)) AS b FROM stored GROUP BY ALL),
oth AS (SELECT s.id, min(o.b) AS b FROM seg s JOIN own o ON s.translatable AND s.src_hash = o.src_hash AND s.doc_id <> o.doc_id GROUP BY s.id)
SELECT s.id, coalesce(struct_extract(own.b, 3), struct_extract(oth.b, 3), 'pending') AS status, CASE WHEN s.translatable THEN '{NOW}' END AS cfg_hash
FROM seg s LEFT JOIN own ON s.translatable AND s.src_hash = own.src_hash AND s.doc_id = own.doc_id LEFT JOIN oth ON oth.id = s.id""")
def tm_backfill(spark, sf_dir: str) -> DataFrame:
    """All documents imported again: own translations first, then those of other documents."""
    s = segments(spark, sf_dir)
    new = s.select("id", "doc_id", "seq", "src_text", "src_hash", "translatable")
    return memory.backfill(new, s, NOW).select("id", "status", "cfg_hash")


@query(f"""WITH RECURSIVE {TODO}, n AS (SELECT id, doc_id, length(src_text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq, id) AS r FROM todo),
f(id, doc_id, r, batch, cnt, chars) AS (
  SELECT id, doc_id, r, 0, 1, n FROM n WHERE r = 1
  UNION ALL SELECT n.id, n.doc_id, n.r, CASE WHEN f.cnt >= 10 OR f.chars >= 4000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.cnt >= 10 OR f.chars >= 4000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt >= 10 OR f.chars >= 4000 THEN n.n ELSE f.chars + n.n END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.r = f.r + 1)
SELECT doc_id, id, CAST(batch AS BIGINT) AS batch FROM f""")
def batch_packing(spark, sf_dir: str) -> DataFrame:
    return memory.batches(todo(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, t AS (SELECT id, doc_id, seq, src_text, CASE WHEN status <> 'pending' THEN tgt_text END AS tr FROM seg WHERE translatable),
w AS (SELECT id, list_filter(list(tr) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS b, list(src_text) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM t)
SELECT id, sha256(coalesce(array_to_string(b[-2:], chr(10)), '')) AS before_hash, sha256(coalesce(array_to_string(a, chr(10)), '')) AS after_hash FROM w""")
def context_windows(spark, sf_dir: str) -> DataFrame:
    """Two translated neighbours above and two sources below each segment."""
    out = memory.context(segments(spark, sf_dir), 2)
    h = lambda c: F.sha2(F.array_join(c, "\n").cast("binary"), 256)
    return out.select("id", h("before").alias("before_hash"), h("after").alias("after_hash"))


@query(f"WITH {SEGMENTS} SELECT status, count(*) AS n FROM seg WHERE translatable GROUP BY status")
def status_stats(spark, sf_dir: str) -> DataFrame:
    return segs.status_counts(segments(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (status <> 'pending') AS done, count(*) FILTER (status = 'confirmed') AS confirmed FROM seg WHERE translatable GROUP BY doc_id),
d AS (SELECT doc_id AS id, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(confirmed, 0) AS confirmed FROM documents LEFT JOIN a USING (doc_id))
SELECT *, CASE WHEN total = 0 THEN '无内容' WHEN done = 0 THEN '未翻译 0/' || total WHEN done < total THEN '翻译中 ' || done || '/' || total WHEN confirmed = total THEN '已校对完成 ' || confirmed || '/' || total ELSE '已翻译待校对 ' || done || '/' || total END AS state FROM d""")
def doc_state(spark, sf_dir: str) -> DataFrame:
    return segs.document_states(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), segments(spark, sf_dir))


@query(f"""WITH {SEGMENTS} SELECT doc_id, count(*) FILTER (translatable AND status <> 'confirmed' AND tgt_text IS NOT NULL AND trim(tgt_text) <> '') AS stored, count(*) FILTER (status <> 'confirmed' AND {STRIP.format("coalesce(tgt_text, '')")} <> '') AS reviewed,
  count(*) FILTER (translatable AND status <> 'pending' AND cfg_hash IS DISTINCT FROM '{NOW}') AS stale FROM seg GROUP BY doc_id""")
def confirmable(spark, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.groupBy("doc_id").agg(F.count_if(segs.confirmable_stored()).alias("stored"), F.count_if(segs.confirmable()).alias("reviewed"), F.count_if(F.col("translatable") & segs.stale(NOW)).alias("stale"))


@query(f"""WITH {SEGMENTS}, p AS (SELECT count(*) FILTER (translatable AND status = 'pending') AS pending, CAST(coalesce(sum(length(src_text)) FILTER (translatable AND status = 'pending'), 0) AS BIGINT) AS chars,
  count(*) FILTER (translatable AND status <> 'pending' AND cfg_hash IS DISTINCT FROM '{NOW}') AS stale, count(DISTINCT doc_id) AS docs FROM seg)
SELECT *, CAST(floor(chars * 1.05::DOUBLE * 1.3::DOUBLE) AS BIGINT) AS tokens_in, CAST(floor(floor(chars * 1.05::DOUBLE * 1.3::DOUBLE) * 1.3::DOUBLE) AS BIGINT) AS tokens_out FROM p""")
def precheck(spark, sf_dir: str) -> DataFrame:
    return segs.precheck(segments(spark, sf_dir), NOW, slide=2)


@query(f"""WITH {SEGMENTS} SELECT id, doc_id, seq FROM seg WHERE translatable AND (translate(src_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_n%the%' OR translate(coalesce(tgt_text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_n%the%')""")
def search_segments(spark, sf_dir: str) -> DataFrame:
    """A search with wildcards that folds ASCII case."""
    return segs.list_segments(segments(spark, sf_dir), translatable=True, search="Th_n%the").select("id", "doc_id", "seq")


@query(f"WITH {SEGMENTS} SELECT id, sha256(regexp_replace(tgt_text, '(?i)the', '<the>', 'g')) AS after_hash, len(regexp_extract_all(tgt_text, '(?i)the', 0)) AS n FROM seg WHERE tgt_text <> '' AND regexp_matches(tgt_text, '(?i)the')")
def search_replace_preview(spark, sf_dir: str) -> DataFrame:
    out = review.search_replace(segments(spark, sf_dir), "the", "<the>")
    return out.select("id", F.sha2(F.col("after").cast("binary"), 256).alias("after_hash"), F.col("n").cast("long").alias("n"))


@query(f"WITH {SEGMENTS} SELECT id, sha256(regexp_replace(tgt_text, '([a-z]+)\\.', '[\\1]', 'g')) AS after_hash FROM seg WHERE tgt_text <> '' AND regexp_matches(tgt_text, '([a-z]+)\\.')")
def search_replace_regex(spark, sf_dir: str) -> DataFrame:
    out = review.search_replace(segments(spark, sf_dir), r"([a-z]+)\.", r"[\1]", case_sensitive=True, regex=True)
    return out.select("id", F.sha2(F.col("after").cast("binary"), 256).alias("after_hash"))


@query(f"WITH {SEGMENTS}, m AS (SELECT id, tgt_text AS t, '([A-Za-z]+) ([a-z]+)([,.])?' AS p FROM seg WHERE tgt_text <> '') SELECT id, sha256(regexp_replace(t, p, '\\2 \\1\\3', 'g')) AS after_hash, len(regexp_extract_all(t, p, 0)) AS n FROM m WHERE regexp_matches(t, p)")
def search_replace_named(spark, sf_dir: str) -> DataFrame:
    """Named groups, one of which may be absent, in a pattern and a template as Python writes them."""
    out = review.search_replace(segments(spark, sf_dir), r"(?P<one>[A-Za-z]+) (?P<two>[a-z]+)(?P<end>[,.])?", r"\g<two> \g<one>\3", case_sensitive=True, regex=True)
    return out.select("id", F.sha2(F.col("after").cast("binary"), 256).alias("after_hash"), F.col("n").cast("long").alias("n"))


@query(f"WITH {SEGMENTS} SELECT CASE WHEN status = 'machine_translated' AND translatable AND cfg_hash IS DISTINCT FROM '{NOW}' THEN 'pending' ELSE status END AS status, count(*) AS n FROM seg GROUP BY 1")
def stale_to_pending(spark, sf_dir: str) -> DataFrame:
    return review.mark_stale(segments(spark, sf_dir), NOW).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {SEGMENTS}, c AS (SELECT CASE WHEN translatable AND status <> 'confirmed' AND {STRIP.format('''coalesce(tgt_text, '')''')} <> '' THEN 'confirmed' ELSE status END AS status, CASE WHEN translatable AND status <> 'confirmed' AND {STRIP.format('''coalesce(tgt_text, '')''')} <> '' THEN false ELSE review_flag END AS review_flag FROM seg) SELECT status, review_flag, count(*) AS n FROM c GROUP BY ALL")
def confirm_all(spark, sf_dir: str) -> DataFrame:
    return review.confirm(segments(spark, sf_dir)).groupBy("status", "review_flag").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS run_id, count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS done, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 7) AS BIGINT) AS tokens_out,
  round((sum(event_id % 100) * 2.0 + sum(event_id % 7) * 6.0) / 1000000, 9) AS cost FROM events GROUP BY user_id""")
def run_rollup(spark, sf_dir: str) -> DataFrame:
    """Progress and cost per run, from events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "done").when(F.col("event_type") == "error", "failed").otherwise("other")
    items = e.select(F.col("user_id").alias("run_id"), status.alias("status"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"))
    return runs.run_totals(items, 2.0, 6.0).withColumn("cost", F.round("cost", 9))


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'signup' THEN 400 ELSE 402 END AS code FROM events)
SELECT event_id, CASE code WHEN 500 THEN 'ServerError' WHEN 429 THEN 'RateLimitError' WHEN 400 THEN 'ServerError' WHEN 402 THEN 'BalanceError' END AS error, CASE code WHEN 402 THEN 'pause' WHEN 200 THEN NULL ELSE 'retry' END AS recovery FROM s""")
def classify_http(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    code = F.when(t == "error", 500).when(t == "view", 200).when(t == "click", 429).when(t == "signup", 400).otherwise(402)
    error = translate.classify_http(code, F.lit("bad request"))
    return e.select("event_id", error.alias("error"), translate.recovery(error).alias("recovery"))


@query("SELECT conv_id, turn, true AS parsed, sha256(coalesce(text, '')) AS text_hash FROM conversations")
def parse_responses(spark, sf_dir: str) -> DataFrame:
    """Each turn as a well-formed model answer, read back inside the JVM."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    answer = F.to_json(F.struct(F.array(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("t")), F.struct(F.lit("x").alias("id"), F.lit("").alias("t"))).alias("translations")))
    got = translate.parse_translations_column(answer, F.array("turn"))
    return rows.select("conv_id", "turn", (F.size(got) == 1).alias("parsed"), F.sha2(got[0]["t"].cast("binary"), 256).alias("text_hash"))


@query("""WITH p AS (SELECT conv_id, turn, text AS src, lead(role) OVER w AS next_role, lead(text) OVER w AS tgt, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, tgt IS NULL OR regexp_matches(tgt, '^[ \\t-\\r]*$') OR trim(src) = trim(tgt) AS doubtful FROM p WHERE role = 'user' AND next_role = 'assistant'""")
def suspicious_pairs(spark, sf_dir: str) -> DataFrame:
    """User turns and the answers after them as source and target."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("src_text"), F.lead("text").over(w).alias("tgt"), F.lead("role").over(w).alias("next_role"))
    rows = rows.filter("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", segs.suspicious(F.col("tgt"), True).alias("doubtful"))


@query(f"""WITH {RANKED}, best AS (SELECT src_hash, doc_id, min((rk, id)) AS b FROM stored GROUP BY ALL),
hit AS (SELECT t.id, t.src_hash, struct_extract(min(b.b), 2) AS tm_id FROM todo t LEFT JOIN best b ON b.src_hash = t.src_hash AND b.doc_id <> t.doc_id GROUP BY t.id, t.src_hash),
lead AS (SELECT t.src_hash, arg_min(t.src_text, (t.doc_id, t.seq)) AS src FROM todo t JOIN hit USING (id) WHERE tm_id IS NULL GROUP BY t.src_hash)
SELECT h.id, CASE WHEN h.tm_id IS NULL THEN 'machine_translated' ELSE s.status END AS status, sha256(CASE WHEN h.tm_id IS NULL THEN 'T:' || l.src ELSE s.tgt_text END) AS text_hash FROM hit h LEFT JOIN seg s ON s.id = h.tm_id LEFT JOIN lead l ON l.src_hash = h.src_hash""")
def translation_run(spark, sf_dir: str) -> DataFrame:
    """A whole run over all pending segments with the deterministic model: memory, deduplication, batches, answers, fan-out."""
    from textloom.plans.base import glossary
    from textloom.operators.keep import keeper

    s = segments(spark, sf_dir).withColumn("ruby_src", F.array().cast("array<struct<token:string,base:string,rt:string,style:string>>"))
    terms = glossary(spark).withColumn("occurrences", F.lit(1))
    results, _ = translate.run_translation(s, terms, translate.MockModel(), translate.RunConfig("en-US", "de-DE", NOW), keeper(spark))
    return results.select("id", "status", F.sha2(F.col("tgt_text").cast("binary"), 256).alias("text_hash"))


@query(f"""WITH {RANKED}, best AS (SELECT src_hash, doc_id, min((rk, id)) AS b FROM stored GROUP BY ALL),
hit AS (SELECT t.id, t.src_hash, struct_extract(min(b.b), 2) AS tm_id FROM todo t LEFT JOIN best b ON b.src_hash = t.src_hash AND b.doc_id <> t.doc_id GROUP BY t.id, t.src_hash),
lead AS (SELECT t.src_hash, arg_min(t.src_text, (t.doc_id, t.seq)) AS src, arg_min(t.id, (t.doc_id, t.seq)) AS lead_id FROM todo t JOIN hit USING (id) WHERE tm_id IS NULL GROUP BY t.src_hash),
told AS (SELECT h.id, h.tm_id, s.status, s.tgt_text, 'T:' || l.src AS answer, l.lead_id % 97 = 0 AS refused, l.lead_id % 89 = 0 AS omitted FROM hit h LEFT JOIN seg s ON s.id = h.tm_id LEFT JOIN lead l ON l.src_hash = h.src_hash)
SELECT id, CASE WHEN tm_id IS NOT NULL THEN status WHEN refused OR omitted THEN 'failed' ELSE 'machine_translated' END AS status,
  CASE WHEN tm_id IS NOT NULL THEN sha256(tgt_text) WHEN NOT (refused OR omitted) THEN sha256(answer) END AS text_hash,
  0 AS asked_twice FROM told""")
def translation_run_resumed(spark, sf_dir: str) -> DataFrame:
    """A run with a model that fails at first, refuses, omits and garbles by rule; it is stopped after one micro-batch and taken up again.

    ``asked_twice``: requests that the ledger has more than one entry of.
    """
    from itertools import count

    from textloom.operators.keep import keeper
    from textloom.operators.ledger import Ledger
    from textloom.plans.base import glossary

    s = segments(spark, sf_dir).withColumn("ruby_src", F.array().cast("array<struct<token:string,base:string,rt:string,style:string>>"))
    terms = glossary(spark).withColumn("occurrences", F.lit(1))
    model = translate.UnreliableModel(refuse_every=97, omit_every=89, late_every=7, garble_every=83, fails_first=True)
    home = keeper(spark)(spark.range(1), "ledger-of")
    ledger = Ledger(home.inputFiles()[0].rpartition("/")[0] + "-entries", size=200)
    cfg = translate.RunConfig("en-US", "de-DE", NOW, pause=0.0)
    turns = count()
    translate.run_translation(s, terms, model, cfg, keeper(spark), ledger=ledger, stop=lambda: next(turns) > 0)
    results, _ = translate.run_translation(s, terms, model, cfg, keeper(spark), ledger=ledger)
    again = ledger.entries(spark).groupBy("stage", "req", "key").count().filter("count > 1").count()
    return results.select("id", "status", F.sha2(F.col("tgt_text").cast("binary"), 256).alias("text_hash"), F.lit(again).alias("asked_twice"))


#: Three replacements one after the other; each counts where it changes something.
EDITS = [("the", "<the>"), ("e", "E"), ("T:", "X:e")]


def _edits_sql() -> str:
    steps = ["e0 AS (SELECT id, tgt_text AS t0, status AS s0 FROM seg WHERE tgt_text <> '')"]
    for k, (old, new) in enumerate(EDITS):
        steps.append(f"e{k + 1} AS (SELECT *, replace(t{k}, '{old}', '{new}') AS t{k + 1}, CASE WHEN contains(t{k}, '{old}') THEN 'human_edited' ELSE s{k} END AS s{k + 1} FROM e{k})")
    return ", ".join(steps)


@query(f"""WITH {SEGMENTS}, {_edits_sql()} SELECT id, sha256(t3) AS h3, s3, sha256(t2) AS h2, s2, sha256(t1) AS h1, s1, sha256(t0) AS h0, s0,
  contains(t0, 'the')::INT + contains(t1, 'e')::INT + contains(t2, 'T:')::INT AS changes FROM e3""")
def undo_history(spark, sf_dir: str) -> DataFrame:
    """Three overlapping replacements, undone one by one: texts and states after each of them and after each step back."""
    from textloom.operators import history
    from textloom.operators.keep import keeper

    # each state is written: later ones would repeat all work before them, twice over with each operation
    keep = keeper(spark)
    now, log = keep(segments(spark, sf_dir).filter("tgt_text <> ''").select("id", "doc_id", "tgt_text", "status"), "state-0"), history.empty(spark)
    for k, (old, new) in enumerate(EDITS):
        now, changes = review.apply_preview(now, keep(review.search_replace(now, old, new, case_sensitive=True), f"preview-{k + 1}"))
        log, now = history.push(log, changes, f"{old} -> {new}"), keep(now, f"state-{k + 1}")
    state = lambda df, k: df.select("id", F.lit(k).alias("k"), F.sha2(F.col("tgt_text").cast("binary"), 256).alias("h"), F.col("status").alias("s"))
    out, left = state(now, len(EDITS)), log
    for k in reversed(range(len(EDITS))):
        now, left = history.undo_last(now, left)
        now = keep(now, f"back-{k}")
        out = out.unionByName(state(now, k))
    out = out.unionByName(log.select(F.col("seg_id").alias("id"), F.lit(-1).alias("k"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("s")))
    # side by side by one sort; a chain of joins would hold one for each state at a time
    of = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in reversed(range(len(EDITS) + 1)) for c in ("h", "s")]
    return out.groupBy("id").agg(*of, F.count_if(F.col("k") == -1).cast("int").alias("changes"))
