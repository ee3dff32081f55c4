"""Queries over texts: segments, hashes, slots, candidates, terms, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import export, runs, terms
from textloom.operators.keep import keeper
from textloom.plans.base import EMPTY, FORMER, GLOSSARY, LINES, SEGMENTS, STRIP, glossary, glossary_sql, lines, segments, spread, table
from textloom.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {LINES}, s AS (SELECT lang, doc_id, NOT ({EMPTY.format('src_text')}) AS tr, sha256({STRIP.format('src_text')}) AS h FROM line)
SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS segments, count(*) FILTER (tr) AS translatable_segments, count(DISTINCT h) FILTER (tr) AS texts,
  round(1 - count(DISTINCT h) FILTER (tr) / greatest(count(*) FILTER (tr), 1), 4) AS repeated_share FROM s GROUP BY lang""")
def segment_overview(spark, sf_dir: str) -> DataFrame:
    """Per language: documents, segments, and how much of them repeats."""
    rows = lines(spark, sf_dir).select("lang", "doc_id", (~T.effectively_empty(F.col("src_text"))).alias("tr"), T.src_hash(F.col("src_text")).alias("h"))
    out = rows.groupBy("lang").agg(
        F.countDistinct("doc_id").alias("docs"), F.count("*").alias("segments"), F.count_if("tr").alias("translatable_segments"), F.countDistinct(F.when(F.col("tr"), F.col("h"))).alias("texts")
    )
    return out.withColumn("repeated_share", F.round(1 - F.col("texts") / F.greatest(F.col("translatable_segments"), F.lit(1)), 4))


@query(f"""WITH {LINES} SELECT doc_id, seq, NOT ({EMPTY.format('src_text')}) AS translatable, sha256({STRIP.format('src_text')}) AS src_hash, length(src_text) AS chars FROM line""")
def segment_lines(spark, sf_dir: str) -> DataFrame:
    c = F.col("src_text")
    return lines(spark, sf_dir).select("doc_id", "seq", (~T.effectively_empty(c)).alias("translatable"), T.src_hash(c).alias("src_hash"), F.length(c).cast("long").alias("chars"))


def _long_lines_sql() -> str:
    """Long lines: a mark after each end of a sentence, then sentences are gathered one by one; the others are one part."""
    closers = T.CLOSERS.replace("'", "''")
    return f"""
marked AS (SELECT doc_id, seq, src_text, regexp_replace(regexp_replace(src_text, '([{T.ENDERS}][{closers}]*)', '\\1' || chr(1), 'g'), '(\\.[{closers}]*)([ \\t\\r]|$)', '\\1' || chr(1) || '\\2', 'g') AS m FROM line WHERE length(src_text) > 1500),
told AS (SELECT doc_id, seq, list_filter(string_split(m, chr(1)), lambda x: x <> '') AS ss FROM marked),
gather AS (
  SELECT doc_id, seq, ss, 0 AS k, '' AS buf, []::VARCHAR[] AS parts FROM told
  UNION ALL
  SELECT doc_id, seq, ss, k + 1, CASE WHEN length(buf || ss[k + 1]) >= 1500 THEN '' ELSE buf || ss[k + 1] END,
    CASE WHEN length(buf || ss[k + 1]) >= 1500 THEN list_concat(parts, list_transform(range((length(buf || ss[k + 1]) + 1499) // 1500), lambda i: substr(buf || ss[k + 1], 1500 * i + 1, 1500))) ELSE parts END
  FROM gather WHERE k < len(ss)),
whole AS (SELECT doc_id, seq AS line, CASE WHEN buf <> '' THEN list_append(parts, buf) ELSE parts END AS parts FROM gather WHERE k = len(ss)
  UNION ALL SELECT doc_id, seq, [src_text] FROM line WHERE length(src_text) <= 1500),
part AS (SELECT doc_id, line, unnest(parts) AS src_text, unnest(range(len(parts))) AS part FROM whole)"""


@query(f"""WITH RECURSIVE {LINES}, {_long_lines_sql()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) - 1 AS seq, line, part, src_text, NOT ({EMPTY.format('src_text')}) AS translatable, sha256({STRIP.format('src_text')}) AS src_hash FROM part""")
def split_long_parts(spark, sf_dir: str) -> DataFrame:
    """Segments as an import makes them, long lines cut."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return formats.sequenced(formats.line_segments(docs))


@query(f"""WITH {LINES} SELECT doc_id, seq, regexp_extract_all(src_text, '[0-9]', 0)::VARCHAR = regexp_extract_all(replace(src_text, '1', ''), '[0-9]', 0)::VARCHAR AS slots_match FROM line""")
def placeholder_check(spark, sf_dir: str) -> DataFrame:
    """Digits stand for slots; a target that lost every 1 matches where there was none."""
    slot = lambda c: F.regexp_replace(c, "([0-9])", "{$1}")
    src, tgt = slot(F.col("src_text")), slot(F.replace(F.col("src_text"), F.lit("1"), F.lit("")))
    return lines(spark, sf_dir).select("doc_id", "seq", T.slots_match(src, tgt).alias("slots_match"))


@query(f"""WITH {LINES} SELECT doc_id, seq, 2 * len(regexp_extract_all(src_text, '[\\x{{4e00}}-\\x{{9fff}}]', 0)) < length(src_text) AS latin,
  CAST(floor(len(regexp_extract_all(src_text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]', 0)) * 1.1::DOUBLE
    + (length(src_text) - len(regexp_extract_all(src_text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]', 0))) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM line""")
def token_estimates(spark, sf_dir: str) -> DataFrame:
    c = F.col("src_text")
    return lines(spark, sf_dir).select("doc_id", "seq", T.mostly_latin(c).alias("latin"), T.estimate_tokens(c).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS = f"""
found AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]{{2,}}', 0), lambda w: lower(w) NOT IN ({_STOP})) AS ws FROM documents WHERE text IS NOT NULL),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM found),
top AS (SELECT word, count(*) AS n, min((doc_id, p)) AS first FROM word GROUP BY word ORDER BY n DESC, first LIMIT 300)"""


@query(f"WITH {WORDS} SELECT word, n FROM top WHERE n >= 2")
def word_candidates(spark, sf_dir: str) -> DataFrame:
    """The 300 most frequent words, ties by first occurrence (the limit is the operator's own)."""
    return terms.candidate_words(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("word", "n")


@query(f"WITH {WORDS}, k AS (SELECT word, (row_number() OVER (ORDER BY n DESC, first) - 1) // 40 AS batch FROM top WHERE n >= 2) SELECT batch, count(*) AS n, min(word) AS least FROM k GROUP BY batch")
def candidate_batches(spark, sf_dir: str) -> DataFrame:
    words = terms.candidate_words(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    k = words.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1) / 40))  # 300 rows at most
    return k.groupBy("batch").agg(F.count("*").alias("n"), F.min("word").alias("least"))


@query(f"""WITH {SEGMENTS}, {glossary_sql('g', GLOSSARY)},
hit AS (SELECT g.ord, s.id, s.doc_id, s.seq, s.status, len(list_filter(g.cands, lambda c: contains(lower(coalesce(s.tgt_text, '')), lower(c)))) > 0 AS found FROM seg s JOIN g ON s.translatable AND contains(s.src_text, g.src)),
src AS (SELECT ord, count(*) AS src_hits FROM hit GROUP BY ord),
sus AS (SELECT ord, string_agg(id, ' ' ORDER BY doc_id, seq) AS suspicious FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY doc_id, seq) AS k FROM hit WHERE NOT found AND status <> 'pending') WHERE k <= 50 GROUP BY ord),
each AS (SELECT ord, unnest(cands) AS c FROM g),
cand AS (SELECT ord, sum(len(regexp_extract_all(coalesce(tgt_text, ''), '(?i)' || CASE WHEN regexp_full_match(c, '[A-Za-z]+') THEN CASE WHEN regexp_matches(c, '(?i)(s|x|ch|sh)$') THEN c || 'es|' ELSE '' END || c || 's|' || c ELSE c END, 0))) AS candidate_hits FROM each, seg WHERE translatable GROUP BY ord)
SELECT g.src, array_to_string(g.cands, '|') AS candidates, coalesce(src_hits, 0) AS src_hits, CAST(coalesce(candidate_hits, 0) AS BIGINT) AS candidate_hits, coalesce(suspicious, '') AS suspicious,
  CASE WHEN coalesce(candidate_hits, 0) > 0 OR coalesce(src_hits, 0) = 0 THEN 'ok' ELSE 'missing' END AS status
FROM g LEFT JOIN src USING (ord) LEFT JOIN sus USING (ord) LEFT JOIN cand USING (ord)""")
def term_consistency(spark, sf_dir: str) -> DataFrame:
    report = terms.consistency(segments(spark, sf_dir), glossary(spark))
    return report.select("src", "candidates", "src_hits", "candidate_hits", F.array_join(F.col("suspicious").cast("array<string>"), " ").alias("suspicious"), "status")


@query(f"""WITH {WORDS}, t AS (SELECT word AS src, n FROM top WHERE n >= 2),
hit AS (SELECT doc_id, src, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, src) AS k FROM documents JOIN t ON contains(text, src))
SELECT doc_id, count(*) AS n_terms, string_agg(src, ' ' ORDER BY k) AS terms FROM hit WHERE k <= 60 GROUP BY doc_id""")
def filter_terms_top60(spark, sf_dir: str) -> DataFrame:
    """Terms that occur in a text, the 60 most frequent of them (the limit is the operator's own)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    t = keeper(spark)(terms.candidate_words(docs).select(F.col("word").alias("src"), "n"), "terms")  # read for the automata, their size and the join
    hit = terms.containing(docs, t, "text").drop("text")
    top = hit.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "src"))), 1, 60).alias("top"))
    return top.select("doc_id", F.size("top").cast("long").alias("n_terms"), F.array_join(F.transform("top", lambda x: x["src"]), " ").alias("terms"))


_OLD, _NEW = glossary_sql("o", FORMER), glossary_sql("g", GLOSSARY)
DIFF = f"{_OLD}, {_NEW}, diff AS (SELECT coalesce(o.src, g.src) AS src, o.cands AS oc, g.cands AS nc FROM o FULL JOIN g ON o.src = g.src WHERE o.cands IS DISTINCT FROM g.cands)"


def learnt(spark, sf_dir: str) -> DataFrame:
    """A glossary of the frequent words of the texts: (ord, src, cands, note, n); 300 at most."""
    words = keeper(spark)(terms.candidate_words(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "learnt")  # used several times
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("int").alias("ord")
    return words.select(number, F.col("word").alias("src"), F.array(F.upper("word"), F.concat(F.lit("n"), F.col("n"))).alias("cands"), F.lit("").alias("note"), "n")


LEARNT = f"{WORDS}, terms AS (SELECT row_number() OVER (ORDER BY n DESC, first) - 1 AS ord, word AS src, [upper(word), 'n' || n] AS cands, n FROM top WHERE n >= 2)"


@query(f"""WITH {LEARNT}, o AS (SELECT src, CASE WHEN n % 3 = 0 THEN [lower(src)] ELSE cands END AS oc FROM terms WHERE n % 5 <> 0), g AS (SELECT src, cands AS nc FROM terms WHERE n % 7 <> 0)
SELECT src, coalesce(array_to_string(oc, '|'), '') AS old_cands, coalesce(array_to_string(nc, '|'), '') AS new_cands FROM o FULL JOIN g USING (src) WHERE oc IS DISTINCT FROM nc""")
def term_snapshot_diff(spark, sf_dir: str) -> DataFrame:
    """Terms learnt from the texts, some of them added, removed or given other candidates."""
    now = learnt(spark, sf_dir)
    old = now.filter("n % 5 <> 0").withColumn("cands", F.when(F.col("n") % 3 == 0, F.array(F.lower("src"))).otherwise(F.col("cands")))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return terms.snapshot_diff(old, now.filter("n % 7 <> 0")).select("src", joined("old_cands"), joined("new_cands"))


IMPACT = f"""{SEGMENTS}, {DIFF},
former AS (SELECT src AS term, coalesce(nc[1], '') AS new, unnest(oc) AS old, unnest(range(len(oc))) AS pos FROM diff WHERE oc IS NOT NULL),
hit_old AS (SELECT id AS seg_id, doc_id, 'old' AS kind, term, arg_max(old, pos) AS old, min(new) AS new FROM seg JOIN former ON translatable AND contains(tgt_text, former.old) GROUP BY ALL),
hit_miss AS (SELECT id AS seg_id, doc_id, 'missing' AS kind, d.src AS term, '' AS old, d.nc[1] AS new FROM seg JOIN diff d ON translatable AND status <> 'pending' AND tgt_text <> '' AND contains(src_text, d.src)
  WHERE len(d.nc) > 0 AND len(list_filter(d.nc, lambda c: contains(tgt_text, c))) = 0 AND NOT EXISTS (SELECT 1 FROM hit_old h WHERE h.seg_id = seg.id AND h.term = d.src)),
affected AS (SELECT * FROM hit_old UNION ALL SELECT * FROM hit_miss)"""


def affected(spark, sf_dir: str) -> DataFrame:
    return terms.impact(segments(spark, sf_dir), terms.snapshot_diff(glossary(spark, FORMER), glossary(spark)))


@query(f"WITH {IMPACT} SELECT seg_id, doc_id, kind, term, old, new FROM affected")
def term_impact(spark, sf_dir: str) -> DataFrame:
    return affected(spark, sf_dir)


@query(f"WITH {IMPACT} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM affected GROUP BY kind")
def term_impact_summary(spark, sf_dir: str) -> DataFrame:
    return terms.impact_summary(affected(spark, sf_dir))


@query(f"""WITH {IMPACT}, st AS (SELECT seg_id, max(CASE WHEN term = 'est' THEN old END) AS o1, max(CASE WHEN term = 'est' THEN new END) AS n1, max(CASE WHEN term = 'the' THEN old END) AS o2, max(CASE WHEN term = 'the' THEN new END) AS n2 FROM affected WHERE old <> '' AND new <> '' GROUP BY seg_id),
rep AS (SELECT id, tgt_text, CASE WHEN o1 IS NULL THEN tgt_text ELSE replace(tgt_text, o1, n1) END AS t1, o2, n2 FROM seg JOIN st ON seg_id = id),
fin AS (SELECT id, tgt_text, CASE WHEN o2 IS NULL THEN t1 ELSE replace(t1, o2, n2) END AS t2 FROM rep)
SELECT id, sha256(t2) AS after_hash, sha256(tgt_text) AS undone_hash, 'human_edited' AS status FROM fin WHERE t2 <> tgt_text""")
def term_replace_undo(spark, sf_dir: str) -> DataFrame:
    """Former candidates replaced, and the texts after undoing it."""
    segs = segments(spark, sf_dir)
    new, changes = terms.replace_all(segs, affected(spark, sf_dir))
    back = terms.undo(new, changes).select("id", F.sha2(F.col("tgt_text").cast("binary"), 256).alias("undone_hash"))
    hit = new.join(changes.select(F.col("seg_id").alias("id")), "id", "left_semi")
    return hit.select("id", F.sha2(F.col("tgt_text").cast("binary"), 256).alias("after_hash"), "status").join(back, "id")


def _issue_sql() -> str:
    """Each term's problem in glossary order; only candidates that are no longer current count as former."""
    former, out = dict((s, c) for s, c, _ in FORMER), []
    for s, cs, _ in GLOSSARY:
        gone = [c for c in former.get(s, []) if c not in cs]
        old = "".join(f"WHEN contains(t, '{c}') THEN 'old:{s}:{c}' " for c in gone)
        none = " AND ".join(f"NOT contains(t, '{c}')" for c in cs)
        out.append(f"CASE {old}WHEN contains(src_text, '{s}') AND {none} THEN 'missing:{s}:' END")
    return f"[{', '.join(out)}]"


@query(f"WITH {SEGMENTS}, s AS (SELECT id, src_text, coalesce(tgt_text, '') AS t FROM seg) SELECT id, array_to_string(list_filter({_issue_sql()}, lambda x: x IS NOT NULL)[1:3], ' ') AS issues FROM s")
def segment_term_issues(spark, sf_dir: str) -> DataFrame:
    out = terms.issues(segments(spark, sf_dir), [(s, c) for s, c, _ in GLOSSARY], {s: c for s, c, _ in FORMER})
    return out.select("id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["kind"], i["term"], i["old"])), " ").alias("issues"))


@query(f"WITH {LEARNT} SELECT sha256(string_agg(src || chr(31) || array_to_string(cands, '|'), chr(10) ORDER BY src || chr(31) || array_to_string(cands, '|'))) AS terms_hash FROM terms")
def glossary_hash(spark, sf_dir: str) -> DataFrame:
    return terms.effective_hash(learnt(spark, sf_dir))


@query(f"""WITH {LEARNT}, kept AS (SELECT src, cands FROM terms WHERE n % 2 = 0), other AS (SELECT src, [lower(src)] AS cands FROM terms WHERE n % 3 <> 0)
SELECT src, array_to_string(cands, '|') AS cands, '' AS note FROM kept UNION ALL SELECT src, array_to_string(cands, '|'), '' FROM other WHERE src NOT IN (SELECT src FROM kept)""")
def glossary_merge(spark, sf_dir: str) -> DataFrame:
    """A glossary learnt from the texts takes in another one: known terms stay as they are."""
    all_terms = learnt(spark, sf_dir).drop("n")
    n = F.substring(F.col("cands")[1], 2, 20).cast("long")
    other = all_terms.filter(n % 3 != 0).withColumn("cands", F.array(F.lower("src")))
    return terms.merge_glossary(all_terms.filter(n % 2 == 0), other).select("src", F.array_join("cands", "|").alias("cands"), "note")


@query(f"""WITH {WORDS}, p AS (SELECT left(word, 4) AS src, (row_number() OVER (ORDER BY n DESC, first) - 1) // 40 AS batch, (row_number() OVER (ORDER BY n DESC, first) - 1) % 40 AS pos, upper(word) AS cand FROM top WHERE n >= 2),
u AS (SELECT src, cand, min((batch, pos)) AS k FROM p GROUP BY src, cand), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k) AS rn FROM u)
SELECT src, string_agg(cand, '|' ORDER BY rn) AS cands FROM r WHERE rn <= 3 AND src NOT IN ('the', 'and', 'est', 'tion', 'der', 'qzx') GROUP BY src""")
def induced_terms(spark, sf_dir: str) -> DataFrame:
    """Answers of several batches merged: candidates in order of appearance, three at most; glossary terms are left alone."""
    words = terms.candidate_words(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    k = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1  # 300 rows at most
    parsed = words.select(F.substring("word", 1, 4).alias("src"), F.floor(k / 40).alias("batch"), (k % 40).alias("pos"), F.array(F.upper("word")).alias("cands"), F.lit("").alias("note"))
    out = terms.not_in_glossary(terms.merge_induced(parsed), glossary(spark))
    return out.select("src", F.array_join("cands", "|").alias("cands"))


@query(f"""WITH {SEGMENTS} SELECT doc_id, sha256(string_agg(coalesce(CASE WHEN translatable THEN {STRIP.format("coalesce(nullif(tgt_text, ''), src_text)")} END, src_text), chr(10) ORDER BY seq)) AS content_hash FROM seg GROUP BY doc_id""")
def export_txt(spark, sf_dir: str) -> DataFrame:
    """Translated documents as plain text; each digest covers the whole text."""
    rows = _aligned(spark, sf_dir)
    return export.export_text(rows).select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def _aligned(spark, sf_dir: str) -> DataFrame:
    segs = segments(spark, sf_dir)
    blocks = lines(spark, sf_dir).select("doc_id", "seq", F.col("seq").alias("line"), F.lit(0).alias("part"), "src_text", (~T.effectively_empty(F.col("src_text"))).alias("translatable"))
    return export.aligned(blocks, segs)


@query(f"""WITH {SEGMENTS} SELECT doc_id, sha256(string_agg(CASE WHEN translatable THEN {STRIP.format('src_text')} || chr(10) || {STRIP.format("coalesce(nullif(tgt_text, ''), src_text)")} || chr(10) ELSE src_text END, chr(10) ORDER BY seq)) AS content_hash FROM seg GROUP BY doc_id""")
def export_bilingual(spark, sf_dir: str) -> DataFrame:
    return export.export_text(_aligned(spark, sf_dir), "bi_inter").select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query(f"""WITH {SEGMENTS} SELECT doc_id, sha256('| 原文 | 译文 |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || replace(src_text, '|', '\\|') || ' | ' || replace(coalesce(nullif(tgt_text, ''), src_text), '|', '\\|') || ' |', chr(10) ORDER BY seq) || chr(10)) AS content_hash
FROM seg WHERE translatable GROUP BY doc_id""")
def export_md_table(spark, sf_dir: str) -> DataFrame:
    return export.export_table(_aligned(spark, sf_dir)).select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS stem, CAST(row_number() OVER (ORDER BY list_transform(regexp_extract_all(CASE WHEN regexp_matches(url, '^[0-9]') THEN '' ELSE '' END || url, '[0-9]+|[^0-9]+', 0),
  lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(regexp_replace(r, '^0+([0-9])', '\\1'), 40, '0') ELSE lower(r) END), page_id) AS BIGINT) AS place FROM pages""")
def natural_sort(spark, sf_dir: str) -> DataFrame:
    """Place of each page in the natural order of addresses, numbered without one task for all rows."""
    from textloom.operators.store import numbered

    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("stem"), T.natural_key(F.col("url")).alias("key"))
    return numbered(rows, ["key", "page_id"], "place").select("page_id", "stem", F.col("place").cast("long").alias("place"))


@query()
def html_blocks(spark, sf_dir: str) -> DataFrame:
    """Blocks of each page by the HTML reader, with their hashes."""
    pages = spread(table(spark, sf_dir, "pages")).select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    out = formats.parse_files(pages)
    return out.select(F.split("path", r"\.")[0].cast("long").alias("page_id"), "error", "seq", "kind", "is_heading", "translatable", "src_text", "src_hash")


@query("SELECT page_id, 'page.' || page_id || '.de.md' AS target FROM pages")
def target_names(spark, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/page."), F.col("page_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "pages").select("page_id", export.target_name(path, F.lit("img"), "de-DE").alias("target"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE 'ch' END AS model, CASE WHEN lang = 'ja' THEN true ELSE false END AS readings FROM documents")
def language_codes(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", runs.recognition_model(F.col("lang")).alias("model"), T.ruby_enabled(F.col("lang")).alias("readings"))


@query("SELECT page_id, false AS is_local, 'openai' AS provider FROM pages")
def provider_kinds(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", runs.is_local_url(F.col("url")).alias("is_local"), runs.provider_type(F.col("url")).alias("provider"))


@query(r"""SELECT doc_id, sha256(replace(text, '.', '{r0}')) AS with_slots, sha256(regexp_replace(text, ' +([，。！？；、）】》」』,.!?;:])', '\1', 'g')) AS stripped FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def ruby_strip(spark, sf_dir: str) -> DataFrame:
    """Reading slots put after each word of a text and stripped again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slotted = F.replace("text", F.lit("."), F.lit("{r0}"))
    around = F.regexp_replace("text", r"(\pL) ", "$1{r7} ")
    h = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select("doc_id", h(slotted).alias("with_slots"), h(T.strip_ruby_tokens(around)).alias("stripped"))
