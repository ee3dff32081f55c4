"""Queries over files that are made of the given texts: readers, writers, candidates of Han texts, and changes of state."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import export, review, runs, store, terms, words
from textloom.plans.base import LINES, SEGMENTS, STRIP, lines, segments, spread, table
from textloom.sources import formats
from textloom.sources.packages import new_docx, paragraph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- documents as files: a title and the lines of the text, letters, digits and single spaces only ----


def made(spark, sf_dir: str) -> DataFrame:
    """(doc_id, title, paras): the paragraphs that the files below hold. The whole text is cleaned at once: a call a line would take twice as long."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{Alnum} \n]+", ""), " {2,}", " ")
    paras = F.filter(F.transform(F.split(bare, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), paras.alias("paras"))


PARAS = """
paras AS (SELECT doc_id, 'Title ' || doc_id AS title, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^A-Za-z0-9 ]+', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents)"""


def pieces_sql(name: str, source: str, column: str) -> str:
    """Cut a column into pieces of 1,500 characters, as import does where a line has no end of a sentence."""
    return f"{name} AS (SELECT doc_id, p, k, substr({column}, 1500 * k + 1, 1500) AS x FROM (SELECT *, unnest(range((length({column}) + 1499) // 1500)) AS k FROM {source}))"


def _whole(first: str) -> str:
    return f"each AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS p FROM (SELECT doc_id, {first} || ps AS xs FROM paras))"


#: What a block reads once all its pieces are translated, joined as Latin text.
JOINED = "joined AS (SELECT doc_id, p, string_agg('T:' || rtrim(x), ' ' ORDER BY k) AS t, min(w) AS s FROM (SELECT cut.*, each.x AS w FROM cut JOIN each USING (doc_id, p)) GROUP BY doc_id, p)"


def packed(rows: DataFrame, ext: str, build: Callable[[str, list[str]], bytes]) -> DataFrame:
    """(path, content) of package files built from (doc_id, title, paras)."""

    def one(i: int, title: str, paras: list[str]) -> Iterator[tuple[int, dict]]:
        content = build(title, paras)
        yield len(content), {"path": f"{i}.{ext}", "content": content}

    return formats.by_row(rows.select("doc_id", "title", "paras"), one, "path string, content binary")


def plain_file(rows: DataFrame, ext: str, content: Column) -> DataFrame:
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("." + ext)).alias("path"), content.cast("binary").alias("content"))


def rewritten(files: DataFrame, mode: str) -> DataFrame:
    """(path, content) of the files written back, each block translated to T:<source>."""

    def one(path: str, raw: bytes) -> Iterator[tuple[int, dict]]:
        kind = formats.detect_format(path)
        blocks = formats.PARSERS[kind](raw)
        done = {x.seq: "T:" + x.text for x in blocks if x.translatable}
        content = formats.RENDERERS[kind](raw, blocks, done, mode)
        yield len(content), {"path": path, "content": content}

    return formats.by_row(files.select("path", "content"), one, "path string, content binary")


def blocks_of(files: DataFrame, lang: str = "") -> DataFrame:
    """The translatable blocks of each file with their place among them."""
    out = formats.parse_files(files, lang=lang, columns=("path", "seq", "src_hash", "is_heading", "translatable")).filter("translatable")
    number = F.split("path", r"\.")[0].cast("long").alias("doc_id")
    listed = out.groupBy(number).agg(F.array_sort(F.collect_list(F.struct("seq", "src_hash", "is_heading"))).alias("bs"))
    return listed.select("doc_id", F.posexplode("bs").alias("at", "b")).select("doc_id", (F.col("at") + 1).cast("long").alias("place"), F.col("b.src_hash").alias("src_hash"), F.col("b.is_heading").alias("is_heading"))


def digest(files: DataFrame) -> DataFrame:
    return files.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), F.sha2("content", 256).alias("content_hash"))


def markdown(rows: DataFrame) -> DataFrame:
    body = F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), F.col("paras")), "\n\n")
    return plain_file(rows, "md", F.concat(body, F.lit("\n")))


def placed(source: str) -> str:
    """The rows of ``blocks_of`` from pieces; the title is the first paragraph."""
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS place, sha256({STRIP.format('x')}) AS src_hash, p = 0 AS is_heading FROM {source}"


@query(f"WITH {PARAS}, {_whole('''['# ' || title]''')}, {pieces_sql('cut', 'each', 'x')} {placed('cut')}")
def md_blocks(spark, sf_dir: str) -> DataFrame:
    return blocks_of(markdown(made(spark, sf_dir)))


@query(f"WITH {PARAS}, {_whole('''['# ' || title]''')}, {pieces_sql('cut', 'each', 'x')}, {JOINED} SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY p) || chr(10)) AS content_hash FROM joined GROUP BY doc_id")
def md_render(spark, sf_dir: str) -> DataFrame:
    return digest(rewritten(markdown(made(spark, sf_dir)), "target"))


def _in_place(source: str) -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS place, sha256({STRIP.format('x')}) AS src_hash, false AS is_heading FROM {source}"


_MD_BLOCKS = """each AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS p FROM (SELECT doc_id, list_transform(ps, lambda x, i: CASE i % 4 WHEN 0 THEN x || ' {0} and [link]({2}) {1}' WHEN 1 THEN '- ' || x
  WHEN 2 THEN '> ' || x ELSE '| ' || x || ' | two {0} |' || chr(10) || '|---|---|' || chr(10) || '| a | b |' END) AS xs FROM paras))"""


@query(f"WITH {PARAS}, {_MD_BLOCKS}, {pieces_sql('cut', 'each', 'x')} {_in_place('cut')}")
def md_marks(spark, sf_dir: str) -> DataFrame:
    """Markdown with front matter, fences, code, formulas and links in paragraphs, lists, quotations and tables."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def block(x: Column, i: Column) -> Column:
        kind = (i + 1) % 4
        link = text(x, " `co de` and [link](http://u.v/", i.cast("string"), ") $x + y$")
        return F.when(kind == 0, link).when(kind == 1, text("- ", x)).when(kind == 2, text("> ", x)).otherwise(text("| ", x, " | two `z` |\n|---|---|\n| a | b |"))

    body = F.array_join(F.concat(F.array(text("---\ntitle: ", F.col("title"), "\n---")), F.transform("paras", block), F.array(F.lit("```\nno text\n```"))), "\n\n")
    return blocks_of(plain_file(made(spark, sf_dir), "md", F.concat(body, F.lit("\n"))))


_HTML_BLOCKS = """each AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS p FROM (SELECT doc_id, list_concat(
  flatten(list_transform(ps, lambda x, i: CASE i % 3 WHEN 0 THEN [x || ' <b>bold</b>{0}x'] WHEN 1 THEN [x, 'cell'] ELSE [x || ' {0}'] END)),
  list_filter(list_transform(ps, lambda x, i: CASE i % 3 WHEN 0 THEN 'tip ' || i WHEN 2 THEN 'pic ' || i END), lambda x: x IS NOT NULL)) AS xs FROM paras))"""


@query(f"WITH {PARAS}, {_HTML_BLOCKS}, {pieces_sql('cut', 'each', 'x')} {_in_place('cut')}")
def html_marks(spark, sf_dir: str) -> DataFrame:
    """HTML with marks, breaks, code, tables and lists, and texts in attributes, which follow all others."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def block(x: Column, i: Column) -> Column:
        number, kind = (i + 1).cast("string"), (i + 1) % 3
        tip = text('<p title="tip ', number, '">', x, " <b>bold</b><br>x</p>")
        pic = text("<ul><li>", x, ' <code>c</code></li></ul><img alt="pic ', number, '" src="s">')
        return F.when(kind == 0, tip).when(kind == 1, text("<table><tr><td>", x, "</td><td>cell</td></tr></table>")).otherwise(pic)

    body = F.array_join(F.transform("paras", block), "")
    return blocks_of(plain_file(made(spark, sf_dir), "html", text("<html><head></head><body>", body, "</body></html>")))


def _srt(rows: DataFrame) -> DataFrame:
    cues = F.transform("paras", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), x))
    return plain_file(rows, "srt", F.concat(F.array_join(cues, "\n\n"), F.lit("\n")))


@query(f"WITH {PARAS}, cue AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS p FROM paras) SELECT doc_id, p + 1 AS place, sha256(x) AS src_hash, false AS is_heading FROM cue")
def srt_blocks(spark, sf_dir: str) -> DataFrame:
    return blocks_of(_srt(made(spark, sf_dir)))


@query(f"""WITH {PARAS} SELECT doc_id, sha256(array_to_string(list_transform(ps, lambda x, i: i || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || x || chr(10) || 'T:' || x), chr(10) || chr(10)) || chr(10)) AS content_hash FROM paras""")
def srt_round_trip(spark, sf_dir: str) -> DataFrame:
    """Subtitles written with both languages in each cue."""
    return digest(rewritten(_srt(made(spark, sf_dir)), "bi_inter"))


_CUES = """cue AS (SELECT doc_id, list_transform(ps, lambda x, i: CASE WHEN i % 3 = 0 THEN '' ELSE i || chr(13) || chr(10) END || '00:00:01,000 --> 00:00:02,000' || chr(13) || chr(10)) AS heads, list_transform(ps, lambda x: '{\\an8}<i>' || x || '</i>') AS xs FROM paras)"""


@query(f"""WITH {PARAS}, {_CUES} SELECT doc_id, sha256(array_to_string(list_transform(xs, lambda x, i: heads[i] || x || chr(13) || chr(10) || 'T:' || x), repeat(chr(13) || chr(10), 3)) || chr(13) || chr(10)) AS content_hash FROM cue""")
def srt_marks(spark, sf_dir: str) -> DataFrame:
    """Subtitles with marks that stay whole, some cues without a number, blank lines between and CRLF, written with both languages in each cue."""
    head = lambda i: F.concat(F.when((i + 1) % 3 == 0, "").otherwise(F.concat((i + 1).cast("string"), F.lit("\r\n"))), F.lit("00:00:01,000 --> 00:00:02,000\r\n"))
    cues = F.transform("paras", lambda x, i: F.concat(head(i), F.lit("{\\an8}<i>"), x, F.lit("</i>")))
    return digest(rewritten(plain_file(made(spark, sf_dir), "srt", F.concat(F.array_join(cues, "\r\n\r\n\r\n"), F.lit("\r\n"))), "bi_inter"))


@query(f"WITH {PARAS}, each AS (SELECT doc_id, unnest(list_transform(ps, lambda x: x || '漢{{r0}}だ 字{{r1}}')) AS x, unnest(range(len(ps))) AS p FROM paras), {pieces_sql('cut', 'each', 'x')} {_in_place('cut')}")
def txt_readings(spark, sf_dir: str) -> DataFrame:
    """Japanese text files: readings become slots, empty lines are no blocks."""
    body = F.array_join(F.transform("paras", lambda x: F.concat(x, F.lit("漢《かん》だ 字《じ》"))), "\n\n")
    return blocks_of(plain_file(made(spark, sf_dir), "txt", body), lang="ja-JP")


def _html(rows: DataFrame) -> DataFrame:
    body = F.array_join(F.transform("paras", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return plain_file(rows, "html", F.concat(F.lit("<html><head></head><body><h1>"), F.col("title"), F.lit("</h1>"), body, F.lit("</body></html>")))


@query(f"WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')} {placed('cut')}")
def html_parse(spark, sf_dir: str) -> DataFrame:
    return blocks_of(_html(made(spark, sf_dir)))


@query(f"""WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')}, {JOINED} SELECT doc_id, sha256('<html><head></head><body>' || string_agg(CASE WHEN p = 0 THEN '<h1>' || t || '</h1>' ELSE '<p>' || t || '</p>' END, '' ORDER BY p) || '</body></html>') AS content_hash FROM joined GROUP BY doc_id""")
def html_render(spark, sf_dir: str) -> DataFrame:
    return digest(rewritten(_html(made(spark, sf_dir)), "target"))


def _docx(title: str, paras: list[str]) -> bytes:
    return new_docx([paragraph(title, 1), *map(paragraph, paras)])


@query(f"WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')} {placed('cut')}")
def docx_blocks(spark, sf_dir: str) -> DataFrame:
    return blocks_of(packed(made(spark, sf_dir), "docx", _docx))


@query(f"WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')}, {JOINED}, {pieces_sql('again', 'joined', 't')} {placed('again')}")
def docx_render(spark, sf_dir: str) -> DataFrame:
    """Written with the translations and read again."""
    return blocks_of(rewritten(packed(made(spark, sf_dir), "docx", _docx), "target"))


def _epub(title: str, paras: list[str]) -> bytes:
    """Two chapters, the second one first in the package, in reading order by the spine."""
    out = io.BytesIO()
    page = lambda body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in "ba")
        z.writestr("o/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/b.xhtml", page("".join(f"<p>{x}</p>" for x in paras)))
        z.writestr("o/a.xhtml", page(f"<h1>{title}</h1>"))
    return out.getvalue()


@query(f"WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')} {placed('cut')}")
def epub_blocks(spark, sf_dir: str) -> DataFrame:
    return blocks_of(packed(made(spark, sf_dir), "epub", _epub))


@query(f"WITH {PARAS}, {_whole('[title]')}, {pieces_sql('cut', 'each', 'x')}, {JOINED}, {pieces_sql('again', 'joined', 't')} {placed('again')}")
def epub_round_trip(spark, sf_dir: str) -> DataFrame:
    """Written with the translations and read again, chapters in the order of the spine."""
    return blocks_of(rewritten(packed(made(spark, sf_dir), "epub", _epub), "target"))


# ---- Han texts: letters of the given texts mapped to characters ----

LATIN, CHARS = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
_HAN = "regexp_replace(translate(coalesce(text, ''), '{}', '{}'), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')".format(LATIN, CHARS)


def han(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), LATIN, CHARS).alias("text"))


@query(f"""WITH h AS (SELECT doc_id, {_HAN} AS t FROM documents), w AS (SELECT doc_id, unnest(range(length(t) - 1)) AS p, t FROM h WHERE length(t) > 1),
top AS (SELECT substr(t, p + 1, 2) AS word, count(*) AS n, min((doc_id, p)) AS first FROM w GROUP BY 1 ORDER BY n DESC, first LIMIT 300) SELECT word, n FROM top WHERE n >= 2""")
def han_candidates(spark, sf_dir: str) -> DataFrame:
    """The 300 most frequent pairs of Han characters, ties by first occurrence (the limit is the operator's own)."""
    return terms.candidate_words(han(spark, sf_dir), "zh").select("word", "n")


@query(f"""WITH h AS (SELECT doc_id, {_HAN} AS t FROM documents), e AS (SELECT *, lead(left(t, 1)) OVER (ORDER BY doc_id) AS b FROM h WHERE t <> '') SELECT right(t, 1) || b AS word, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY 1""")
def han_bridges(spark, sf_dir: str) -> DataFrame:
    """Pairs across the border of one document and the next."""
    return terms.bridging_bigrams(han(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


#: The dictionary of ``words.learn_words``: counts of grams over the distinct stretches, cohesion and freedom from them.
DICTIONARY = """
mapped AS (SELECT doc_id, translate(coalesce(text, ''), '{}', '{}') AS t FROM documents),
each AS (SELECT unnest(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]+', 0)) AS run FROM mapped),
runs AS (SELECT run, count(*) AS times FROM each GROUP BY run),
sizes AS (SELECT '^' || run || '$' AS b, times, unnest(range(1, 6)) AS k FROM runs),
spots AS (SELECT b, times, k, unnest(range(1, length(b) - k + 2)) AS i FROM sizes WHERE length(b) >= k),
grams AS (SELECT substr(b, i, k) AS g, sum(times)::BIGINT AS n FROM spots GROUP BY 1),
pure AS (SELECT * FROM grams WHERE g[1] <> '^' AND g[-1] <> '$'),
whole AS (SELECT sum(n)::DOUBLE AS w FROM pure WHERE length(g) = 1),
words AS (SELECT g AS word, n FROM pure WHERE length(g) BETWEEN 2 AND 4 AND n >= 5),
held AS (SELECT word, c.n, min(ln(c.n::DOUBLE * w / (a.n::DOUBLE * b.n::DOUBLE))) AS held FROM (SELECT *, unnest(range(1, length(word))) AS i FROM words) c
  JOIN pure a ON a.g = left(word, i) JOIN pure b ON b.g = substr(word, i + 1), whole GROUP BY ALL),
after AS (SELECT left(g, length(g) - 1) AS word, ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n) AS h FROM grams WHERE g[1] <> '^' AND length(g) BETWEEN 3 AND 5 GROUP BY 1),
before AS (SELECT right(g, length(g) - 1) AS word, ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n) AS h FROM grams WHERE g[-1] <> '$' AND length(g) BETWEEN 3 AND 5 GROUP BY 1),
known AS (SELECT word, n FROM held JOIN after USING (word) JOIN before USING (word) WHERE held >= 1 AND least(after.h, before.h) >= 0.5 UNION ALL SELECT g, n FROM pure WHERE length(g) = 1),
dictionary AS (SELECT word, n, floor(1000000 * ln(n::DOUBLE / w))::BIGINT AS score FROM known, whole)""".format(LATIN, CHARS)

#: The best path to each place of a stretch: the scores and words of the last four places are carried along.
PATHS = """
path AS (
  SELECT run, times, 0 AS t, [0::BIGINT] AS b, [[]::VARCHAR[]] AS w FROM runs
  UNION ALL
  SELECT run, times, t + 1, list_prepend(x.s, b)[1:4], list_prepend(list_append(w[x.l], substr(run, t + 2 - x.l, x.l)), w)[1:4]
  FROM (SELECT p.*, list_max(list_filter([{'s': b[1] + d1.score, 'l': 1}, {'s': b[2] + d2.score, 'l': 2}, {'s': b[3] + d3.score, 'l': 3}, {'s': b[4] + d4.score, 'l': 4}], lambda c: c.s IS NOT NULL)) AS x
    FROM path p LEFT JOIN dictionary d1 ON d1.word = substr(run, t + 1, 1) LEFT JOIN dictionary d2 ON t >= 1 AND d2.word = substr(run, t, 2)
      LEFT JOIN dictionary d3 ON t >= 2 AND d3.word = substr(run, t - 1, 3) LEFT JOIN dictionary d4 ON t >= 3 AND d4.word = substr(run, t - 2, 4)
    WHERE t < length(run)))"""


@query(f"WITH {DICTIONARY} SELECT word, n, score FROM dictionary")
def han_dictionary(spark, sf_dir: str) -> DataFrame:
    """Words learnt from all texts by frequency, cohesion and freedom."""
    return words.learn_words(han(spark, sf_dir))


@query(f"WITH RECURSIVE {DICTIONARY}, {PATHS} SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, unnest(w[1]) AS word FROM path WHERE t = length(run)) WHERE length(word) >= 2 GROUP BY word")
def han_words(spark, sf_dir: str) -> DataFrame:
    """How often each word of two characters or more stands on the best paths of all texts."""
    return words.chinese_words(han(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


# ---- order and numbers over many rows ----


@query(f"""WITH {LINES}, n AS (SELECT doc_id, seq, 'Part' || (seq % 20) || '_' || doc_id || '.txt' AS name FROM line)
SELECT doc_id, seq, row_number() OVER (ORDER BY seq % 20, doc_id, seq) AS place FROM n""")
def natural_sort_lines(spark, sf_dir: str) -> DataFrame:
    """Natural order of a name per line, numbered without one task for all rows."""
    name = F.concat(F.lit("Part"), (F.col("seq") % 20).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = lines(spark, sf_dir).select("doc_id", "seq", T.natural_key(name).alias("key"))
    return store.numbered(rows, ["key", "seq"], "place").select("doc_id", "seq", F.col("place").cast("long").alias("place"))


# ---- changes of state ----


def stored_documents(spark, sf_dir: str) -> DataFrame:
    """Two thirds of the documents as a stored table; known, read, with a tag."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.lit("txt").alias("format"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("tags"), F.lit(True).alias("terms_extracted"), F.lit("new").alias("status"),
    )


@query("""WITH d AS (SELECT doc_id, 'd/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents),
n AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN sha256(h) ELSE h END AS h, doc_id FROM d WHERE doc_id % 2 = 0), o AS (SELECT * FROM d WHERE doc_id % 3 <> 0)
SELECT o.doc_id AS id, o.path, CASE WHEN n.path IS NULL THEN 'txt' ELSE 'md' END AS format, coalesce(n.h, o.h) AS content_hash, n.path IS NULL OR n.h = o.h AS terms_extracted, CASE WHEN n.path IS NULL THEN 'new' ELSE 'segmented' END AS status FROM o LEFT JOIN n USING (path)
UNION ALL SELECT (SELECT max(doc_id) FROM o) + row_number() OVER (ORDER BY path), path, 'md', h, false, 'segmented' FROM n WHERE doc_id % 3 = 0""")
def upsert_documents(spark, sf_dir: str) -> DataFrame:
    """Every second document imported again, some of them changed, some of them new; ids of new ones go on in the order of paths."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    new = docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.lit("md").alias("format"), F.when(F.col("doc_id") % 4 == 0, F.sha2(h, 256)).otherwise(h).alias("content_hash"))
    return store.upsert_documents(stored_documents(spark, sf_dir), new).select("id", "path", "format", "content_hash", "terms_extracted", "status")


@query(f"WITH {SEGMENTS} SELECT doc_id, count(*) AS segments FROM seg WHERE doc_id % 7 <> 0 GROUP BY doc_id")
def delete_documents(spark, sf_dir: str) -> DataFrame:
    """Documents deleted with their segments; those of the rest are counted."""
    docs, segs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), segments(spark, sf_dir)
    kept, rest = store.delete_documents(docs, segs, docs.filter("id % 7 = 0"))
    return rest.join(kept.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("segments"))


@query(f"""WITH {SEGMENTS} SELECT id, sha256(coalesce(CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'U' || id ELSE tgt_text END, '')) AS text_hash, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'human_edited' ELSE status END AS status FROM seg""")
def update_segments(spark, sf_dir: str) -> DataFrame:
    """Changes for every third segment, each of one field; a null field leaves the old value."""
    s, even = segments(spark, sf_dir), F.col("id") % 2 == 0
    changes = s.filter("id % 3 = 0").select("id", F.when(even, F.concat(F.lit("U"), F.col("id").cast("string"))).alias("tgt_text"), F.when(~even, "human_edited").alias("status"))
    return store.update(s, changes, "id").select("id", F.sha2(F.coalesce("tgt_text", F.lit("")), 256).alias("text_hash"), "status")


@query(f"""WITH {SEGMENTS}, e AS (SELECT *, CASE WHEN seq % 5 = 0 THEN src_text || ' edited' ELSE src_text END AS s2 FROM seg)
SELECT id, sha256({STRIP.format('s2')}) AS src_hash, CASE WHEN seq % 5 = 0 THEN true ELSE review_flag END AS review_flag, CASE WHEN seq % 4 = 0 THEN 'pending' ELSE status END AS status FROM e""")
def edit_source(spark, sf_dir: str) -> DataFrame:
    """Source texts edited, and others marked to be translated again."""
    s = store.with_source(segments(spark, sf_dir), F.col("seq") % 5 == 0, F.concat("src_text", F.lit(" edited")))
    return review.mark_retranslate(s, F.col("seq") % 4 == 0).select("id", "src_hash", "review_flag", "status")


@query("""SELECT 'lang' AS key, arg_max(lang, doc_id) AS value FROM documents WHERE lang <> '' UNION ALL SELECT 'source', arg_max(source, doc_id) FROM documents WHERE doc_id % 2 = 0 AND source <> ''""")
def tag_union(spark, sf_dir: str) -> DataFrame:
    """Of each tag, the value of the last document that has one."""
    docs = table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))).otherwise(F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))))
    return runs.union_tags(docs.select(F.col("doc_id").alias("id"), tags.alias("tags")))


# ---- small rules over all their branches ----


@query("""SELECT doc_id, 'page.' || doc_id || '.de' || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '' ELSE '.epub' END AS own,
  'page.' || doc_id || '.de' || CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.html' WHEN 2 THEN '.html' ELSE '.epub' END AS cross_format FROM documents""")
def target_names_all(spark, sf_dir: str) -> DataFrame:
    """Names of targets in the own format and in another one."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    ext = F.when(k == 0, ".png").when(k == 1, ".TXT").when(k == 2, "").otherwise(".epub")
    stem = F.when(k == 2, F.concat(F.lit("page."), i, F.lit("."))).otherwise(F.concat(F.lit("page."), i))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in.d/"), stem, ext).alias("path"), F.when(k == 0, "img").when(k == 1, "txt").when(k == 2, "txt").otherwise("html").alias("fmt"))
    own = export.target_name(F.col("path"), F.col("fmt"), "de-DE")
    return docs.select("doc_id", F.regexp_replace(own, r"\.$", "").alias("own"), export.target_name(F.col("path"), F.col("fmt"), "de-DE", "html").alias("cross_format"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'japan' WHEN 1 THEN 'ch' WHEN 2 THEN 'korean' WHEN 3 THEN 'en' ELSE 'ch' END AS model, doc_id % 6 = 0 AS readings FROM documents""")
def language_codes_all(spark, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("ja-JP", "zh-TW", "ko", "EN-gb", "", "xx"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", runs.recognition_model(code).alias("model"), T.ruby_enabled(code).alias("readings"))


@query("""SELECT doc_id, (doc_id % 8) IN (0, 1, 2, 3, 7) AS is_local, CASE doc_id % 8 WHEN 4 THEN 'anthropic' WHEN 5 THEN 'gemini' ELSE 'openai' END AS provider FROM documents""")
def provider_kinds_all(spark, sf_dir: str) -> DataFrame:
    urls = ("http://localhost:1/v1", "http://127.0.0.1", "http://u:p@192.168.1.2:80/v1", "https://box.local/v1", "https://api.Anthropic.com", "https://generativelanguage.googleapis.com", "https://172.32.0.1/v1", "http://[::1]:11434/v1")
    url = F.element_at(F.array(*map(F.lit, urls)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", runs.is_local_url(url).alias("is_local"), runs.provider_type(url).alias("provider"))
