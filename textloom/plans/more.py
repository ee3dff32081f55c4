"""Queries over protected fragments, readings, lists, glossary edits and results of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import memory, project, runs, segments as segs, store, terms, translate
from textloom.plans.base import LINES, SEGMENTS, STRIP, lines, segments, table
from textloom.plans.content import IMPACT, LEARNT, affected, learnt

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


# ---- slots and readings ----


@query(f"""WITH {LINES}, coded AS (SELECT doc_id, seq, regexp_replace(translate(src_text, '`{{}}', ''), '([A-Z][a-z]+)', '`\\1`', 'g') AS c FROM line), parts AS (SELECT *, string_split(c, '`') AS ps FROM coded)
SELECT doc_id, seq, sha256(array_to_string(list_transform(ps, lambda p, i: CASE WHEN i % 2 = 0 THEN '{{' || (i // 2 - 1) || '}}' ELSE p END), '')) AS text_hash, len(ps) // 2 AS slots, sha256(c) AS restored_hash FROM parts""")
def protected_fragments(spark, sf_dir: str) -> DataFrame:
    """Words with a capital as code: protected by slots and put back."""
    c = F.regexp_replace(F.translate("src_text", "`{}", ""), "([A-Z][a-z]+)", "`$1`")
    rows = lines(spark, sf_dir).select("doc_id", "seq", T.protect(c, [r"`[^`\n]+`"]).alias("p"))
    return rows.select("doc_id", "seq", _sha(F.col("p.text")).alias("text_hash"), F.size("p.slots").cast("long").alias("slots"), _sha(T.restore(F.col("p.text"), F.col("p.slots"))).alias("restored_hash"))


_BASE = "[\\x{4e00}-\\x{9fff}々〆\\x{30A0}-\\x{30FF}ーA-Za-z0-9]{1,20}$"


@query(f"""WITH {LINES}, given AS (SELECT doc_id, seq, regexp_replace(translate(src_text, '《》{{}}', ''), '([A-Za-z]+) ', '\\1《r》 ', 'g') AS c FROM line), parts AS (SELECT *, string_split(c, '《r》') AS ps FROM given)
SELECT doc_id, seq, sha256(array_to_string(list_transform(ps, lambda p, i: CASE WHEN i < len(ps) THEN p || '{{r' || (i - 1) || '}}' ELSE p END), '')) AS text_hash, len(ps) - 1 AS readings,
  sha256(array_to_string(list_transform(ps[1:len(ps) - 1], lambda p: regexp_extract(p, '{_BASE}')), ' ')) AS bases_hash, sha256(c) AS restored_hash FROM parts""")
def reading_slots(spark, sf_dir: str) -> DataFrame:
    """A reading after each word: taken out as slots, with what they belong to, and put back."""
    c = F.regexp_replace(F.translate("src_text", "《》{}", ""), "([A-Za-z]+) ", "$1《r》 ")
    rows = lines(spark, sf_dir).select("doc_id", "seq", T.rubyize_aozora(c).alias("p"))
    bases = F.array_join(F.transform("p.entries", lambda e: e["base"]), " ")
    return rows.select("doc_id", "seq", _sha(F.col("p.text")).alias("text_hash"), F.size("p.entries").cast("long").alias("readings"), _sha(bases).alias("bases_hash"), _sha(T.restore_ruby(F.col("p.text"), F.col("p.entries"))).alias("restored_hash"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, seq, src_text, strpos(src_text, 'the') AS p FROM line) SELECT doc_id, seq, CASE WHEN p > 0 THEN substr(src_text, greatest(p - 20, 1), p + 23 - greatest(p - 20, 1)) ELSE left(src_text, 60) END AS shown FROM s""")
def snippets(spark, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "seq", T.snippet(F.col("src_text"), F.lit("the")).alias("shown"))


@query(f"""WITH {LINES} SELECT doc_id, seq, array_to_string(list_filter(list_transform(string_split(replace(src_text, ' ', '|'), '|'), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1:3], '/') AS cands FROM line""")
def candidate_lists(spark, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "seq", F.array_join(T.candidates(F.replace("src_text", F.lit(" "), F.lit("|"))), "/").alias("cands"))


# ---- context, imports, documents ----

_FITS = "coalesce(list_sum(list_transform(x, lambda y: length(y))), 0) + coalesce(list_sum(list_transform({}, lambda y: length(y))), 0) <= 300"


@query(f"""WITH {SEGMENTS}, t AS (SELECT id, doc_id, seq, src_text, CASE WHEN status <> 'pending' THEN tgt_text END AS tr FROM seg WHERE translatable),
w AS (SELECT id, list_filter(coalesce(list(tr) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), lambda x: x IS NOT NULL)[-3:] AS b, coalesce(list(src_text) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS a FROM t),
c AS (SELECT id, a, coalesce(list_filter([b, b[2:], b[3:], b[4:]], lambda x: {_FITS.format('a')})[1], []) AS b FROM w)
SELECT id, len(b) AS above, len(coalesce(list_filter([a, a[1:len(a) - 1], a[1:greatest(len(a) - 2, 0)], []], lambda x: {_FITS.format('b')})[1], [])) AS below FROM c""")
def capped_context(spark, sf_dir: str) -> DataFrame:
    """How many of three neighbours on each side fit into 300 characters."""
    b, a = memory.cap_context(F.col("before"), F.col("after"), 300)
    return memory.context(segments(spark, sf_dir), 3).select("id", F.size(b).cast("long").alias("above"), F.size(a).cast("long").alias("below"))


@query(f"WITH {SEGMENTS} SELECT doc_id, count(*) AS total, count(*) FILTER (translatable) AS n_translatable, count(*) FILTER (translatable AND tgt_text IS NOT NULL) AS reused FROM seg GROUP BY doc_id")
def import_reuse(spark, sf_dir: str) -> DataFrame:
    return segs.import_counts(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT count(*) FILTER ({STRIP.format('''coalesce(tgt_text, '')''')} = '') AS blank, count(*) FILTER (status = 'confirmed') AS confirmed FROM seg")
def block_reasons(spark, sf_dir: str) -> DataFrame:
    return segs.confirm_block_reason(segments(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT id, 'd/' || doc_id AS doc_path FROM seg")
def segment_paths(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return segs.with_paths(segments(spark, sf_dir), docs).select("id", "doc_path")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'reviewed' ELSE 'segmented' END AS status, doc_id % 3 = 0 AND doc_id % 2 = 0 AS terms_extracted FROM documents""")
def document_fields(spark, sf_dir: str) -> DataFrame:
    """Fields of every third document are set; null leaves a field as it is."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("segmented").alias("status"), F.lit(False).alias("terms_extracted"))
    changes = docs.filter("id % 3 = 0").select("id", F.lit("reviewed").alias("status"), F.when(F.col("id") % 2 == 0, True).alias("terms_extracted"))
    return store.update(docs, changes, "id")


_CODES = ["ja-JP", "en_us", "ZH", "xx", "", "de"]


@query("""SELECT doc_id, ['ja-JP（日语-日本）', 'en_us', 'ZH', 'xx', '', 'de'][doc_id % 6 + 1] AS label, ['ja-JP', 'en-US', 'zh-CN', 'xx', '', 'de-DE'][doc_id % 6 + 1] AS code FROM documents""")
def language_names(spark, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", runs.language_label(code).alias("label"), project.normalize_language(code).alias("code"))


# ---- glossaries ----


@query(f"""WITH {LEARNT} SELECT ord::INT AS ord, src, CASE WHEN ord = 0 THEN 'neu|alt' ELSE array_to_string(cands, '|') END AS cands, CASE WHEN ord = 0 THEN 'note' ELSE '' END AS note FROM terms WHERE ord <> 1
UNION ALL SELECT (max(ord) + 1)::INT, 'Neues Wort', 'a|b|c', '' FROM terms""")
def glossary_edits(spark, sf_dir: str) -> DataFrame:
    """The first term gets other candidates, a new one is added, the second goes."""
    g = learnt(spark, sf_dir).drop("n")
    first, second = (r.src for r in g.orderBy("ord").limit(2).collect())
    g = terms.add_term(terms.add_term(g, f" {first} ", ["neu|alt"], "note"), "Neues Wort", ["a", " b ", "c", "d"])
    return terms.remove_term(g, second).select("ord", "src", F.array_join("cands", "|").alias("cands"), "note")


@query(f"WITH {LEARNT} SELECT src, CASE WHEN n % 2 = 0 THEN n ELSE 1 END::INT AS occurrences FROM terms")
def glossary_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of the cache for the glossary's terms, 1 where it has none."""
    g = learnt(spark, sf_dir)
    return terms.with_occurrences(g.drop("n"), g.filter("n % 2 = 0").select("src", F.col("n").alias("occurrences"))).select("src", "occurrences")


@query(f"""WITH {LEARNT} SELECT 'cache' AS part, src, CASE WHEN n % 3 = 0 THEN 'approved' WHEN n % 3 = 1 THEN 'rejected' ELSE 'candidate' END AS state FROM terms
UNION ALL SELECT 'glossary', src, CASE WHEN n % 2 = 0 THEN 'known' ELSE 'new' END FROM terms WHERE n % 2 = 0 OR n % 3 = 0""")
def glossary_approvals(spark, sf_dir: str) -> DataFrame:
    """Some learnt terms are approved and enter the glossary, others are rejected."""
    g = learnt(spark, sf_dir)
    n = F.substring(F.col("cands")[1], 2, 20).cast("long")
    cache = g.drop("n").withColumn("status", F.lit("candidate"))
    known = g.drop("n").filter(n % 2 == 0).withColumn("note", F.lit("known"))
    cache, known = project.approve(cache, known, cache.filter(n % 3 == 0).select("src"))
    cache = project.reject(cache, cache.filter(n % 3 == 1).select("src"))
    told = F.when(F.col("note") == "known", "known").otherwise("new")
    return cache.select(F.lit("cache").alias("part"), "src", F.col("status").alias("state")).unionByName(known.select(F.lit("glossary").alias("part"), "src", told.alias("state")))


@query(f"WITH {IMPACT} SELECT id, CASE WHEN id IN (SELECT seg_id FROM affected) THEN 'pending' ELSE status END AS status FROM seg")
def marked_segments(spark, sf_dir: str) -> DataFrame:
    """What changed terms affect goes back to pending."""
    return terms.mark(segments(spark, sf_dir), affected(spark, sf_dir)).select("id", "status")


# ---- results of runs ----


@query(f"""WITH {SEGMENTS}, r AS (SELECT *, translatable AND status = 'pending' AS asked FROM seg)
SELECT id, CASE WHEN asked THEN CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'machine_translated' END ELSE status END AS status, sha256(coalesce(CASE WHEN asked AND id % 3 <> 0 THEN 'R:' || src_text ELSE tgt_text END, '')) AS text_hash,
  CASE WHEN asked AND id % 3 <> 0 THEN 'c9' ELSE cfg_hash END AS cfg_hash, CASE WHEN asked AND id % 3 <> 0 THEN id % 2 = 0 ELSE review_flag END AS review_flag FROM r""")
def applied_results(spark, sf_dir: str) -> DataFrame:
    """Answers for all pending segments, every third without one, put into the table."""
    s = segments(spark, sf_dir).withColumn("ruby_map", F.create_map().cast("map<string,string>"))
    asked, failed = s.filter("translatable and status = 'pending'"), F.col("id") % 3 == 0
    results = asked.select("id", F.when(failed, "failed").otherwise("machine_translated").alias("status"), F.when(~failed, F.concat(F.lit("R:"), "src_text")).alias("tgt_text"), (F.col("id") % 2 == 0).alias("review_flag"), "ruby_map")
    return translate.apply_results(s, results, "c9").select("id", "status", _sha(F.coalesce("tgt_text", F.lit(""))).alias("text_hash"), "cfg_hash", "review_flag")


@query(f"""WITH {SEGMENTS}, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 5 = 0 THEN 'pending' ELSE 'done' END AS status FROM seg WHERE translatable AND status = 'pending')
SELECT row_number() OVER (ORDER BY id) + 6 AS id, 4 AS run_id, id AS segment_id, status, 0 AS retries, CASE WHEN status = 'failed' THEN 'late' ELSE '' END AS error FROM r""")
def run_items(spark, sf_dir: str) -> DataFrame:
    """An item for each segment of a run, numbered in their order."""
    s = segments(spark, sf_dir).filter("translatable and status = 'pending'")
    state = F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 5 == 0, "pending").otherwise("machine_translated")
    return runs.run_items(s.select("id", state.alias("status"), F.lit("late").alias("cause")), 4, first_id=7)

