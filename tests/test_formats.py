"""Readers and writers of documents."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions.plain import FormatError, decode
from textloom.sources import formats as S
from textloom.sources.lines import parse_img, parse_srt, parse_txt, render_img, render_srt, render_txt
from textloom.sources.markdown import parse_md, render_md
from textloom.sources.markup import parse_html, render_html
from textloom.sources.packages import new_docx, paragraph, parse_docx, parse_epub, render_docx, render_epub

MD = "---\ntitle: x\n---\n\n# 标题 `code`\n\n段落 **粗** [链接](http://u)。\n续行\n\n- 项\n- 项二\n  续\n\n> 引用\n\n|a|b|\n|-|-|\n|1|2|\n\n```\nraw\n```\n\n![图](p.png)\n"
SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\nthere\n\n00:00:03.0 --> 00:00:04.0 X1:1\nyo\n\ngarbage\n\n2\n00:00:05,000 --> 00:00:06,000\n{\\an8}\n"
HTML = "<!DOCTYPE html><html><head><title>T</title><meta name='description' content='D'></head><body><h1>A <b>b</b> <code>c</code></h1><p>one<p>two <a href='u'>l</a><img alt='i' src='s'><pre>x</pre><table><tr><td>1<td>2</table></body></html>"


def translate(blocks):
    return {b.seq: "T:" + b.text for b in blocks if b.translatable}


def test_decode():
    assert decode("﻿a".encode()) == "a" and decode("中文内容测试。".encode("gb18030")) == "中文内容测试。"
    with pytest.raises(FormatError):
        decode(b"a\0b")


@pytest.mark.parametrize("text", ["第一段。\n\n第二段。\n第三段。\n", "a\r\n\r\nb", "", "\n", "一段。\n\n\n二段。\n​\n三段。\n"])
def test_txt_round_trip(text):
    blocks = parse_txt(text.encode())
    assert render_txt(text.encode(), blocks, {}) == text.encode()
    assert [b.seq for b in blocks] == list(range(len(blocks)))


def test_txt_modes():
    raw = "第一段。\n\n第二段。\n".encode()
    blocks = parse_txt(raw)
    assert render_txt(raw, blocks, translate(blocks)).decode() == "T:第一段。\n\nT:第二段。\n"
    assert render_txt(raw, blocks, translate(blocks), "bi_inter").decode() == "第一段。\nT:第一段。\n\n\n第二段。\nT:第二段。\n\n"
    with pytest.raises(FormatError):
        render_txt(raw, blocks, {}, "bi_table")


def test_txt_readings_only_in_japanese():
    raw = "僕は一廣《かずひろ》だ。\n".encode()
    assert parse_txt(raw, lang="zh-CN")[0].text == "僕は一廣《かずひろ》だ。"
    blocks = parse_txt(raw, lang="ja-JP")
    assert blocks[0].text == "僕は一廣{r0}だ。"
    assert render_txt(raw, blocks, {0: "I am Kazuhiro{r0}."}, readings={0: {"{r0}": "K"}}).decode() == "I am Kazuhiro《K》.\n"
    assert render_txt(raw, blocks, {}) == raw


def test_long_line_replays():
    raw = ("他运转功法，只觉丹田一热。" * 200 + "\n短。\n").encode()
    blocks = parse_txt(raw)
    assert [b.part for b in blocks] == [0, 1, 2, 0] and render_txt(raw, blocks, {}) == raw


@pytest.mark.parametrize("text", [MD, MD.replace("\n", "\r\n"), "para only\n", "Title\n=====\ntext\n\n    code\n\n1. a\n\n   b\n2. c\n\n<div>\nx\n</div>\n\n***\nend\n"])
def test_md_round_trip(text):
    blocks = parse_md(text.encode())
    assert render_md(text.encode(), blocks, {}).decode() == text


def test_md_blocks():
    kinds = [(b.kind, b.translatable) for b in parse_md(MD.encode()) if b.kind != "gap"]
    assert kinds == [("frontmatter", False), ("heading", True), ("paragraph", True), ("list_item", True), ("list_item", True), ("blockquote", True), ("table", True), ("fence", False), ("empty", False)]
    blocks = parse_md(MD.encode())
    out = render_md(MD.encode(), blocks, translate(blocks), "bi_table").decode()
    assert out.startswith("| 原文 | 译文 |\n|---|---|\n| # 标题 `code` | T:# 标题 `code` |\n") and "\\|a\\|b\\|<br>" in out
    assert "http://u" in render_md(MD.encode(), blocks, translate(blocks), "bi_inter").decode()


@pytest.mark.parametrize("text", [SRT, SRT.replace("\n", "\r\n"), SRT.rstrip("\n"), "", "\n\n", "no cue\n"])
def test_srt_round_trip(text):
    assert render_srt(text.encode(), parse_srt(text.encode()), {}) == text.encode()


def test_srt_heads():
    text = "stray\n\n5\n6\n00:00:01,0 --> 00:00:02,0 X1:1\na\n7\n 0:00:03.5-->0:00:04.5\nb\n9\n\nlost\n00:00:05,000 --> 00:00:06,000\n\n{\\an8}\n8\n00:00:07,000 --> 00:00:08,000"
    got = [(b.kind, b.text, b.translatable, b.extra.get("index"), b.extra.get("timing")) for b in parse_srt(text.encode())]
    assert got == [
        ("gap", "stray", False, None, None), ("gap", "", False, None, None), ("gap", "5", False, None, None), ("cue", "a", True, "6", "00:00:01,0 --> 00:00:02,0 X1:1"), ("cue", "b\n9", True, "7", " 0:00:03.5-->0:00:04.5"),
        ("gap", "", False, None, None), ("gap", "lost", False, None, None), ("cue", "", False, "", "00:00:05,000 --> 00:00:06,000"), ("gap", "", False, None, None), ("gap", "{\\an8}", False, None, None), ("cue", "", False, "8", "00:00:07,000 --> 00:00:08,000"),
    ]
    assert render_srt(text.encode(), parse_srt(text.encode()), {}) == text.encode()


def test_srt_modes():
    blocks = parse_srt(SRT.encode())
    assert [b.kind for b in blocks if b.translatable] == ["cue", "cue"] and blocks[0].text == "{0}Hi{1}\nthere"
    out = render_srt(SRT.encode(), blocks, {0: "{0}Hallo{1}\nda\nmehr", 2: "ja"}, "bi_inter").decode()
    assert out.startswith("1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\n<i>Hallo</i>\nthere\nda\nmehr\n") and "yo\nja\n" in out


def test_html():
    raw = HTML.encode()
    blocks = parse_html(raw)
    assert [(b.kind, b.text) for b in blocks] == [("block", "T"), ("block", "A <b>b</b> {0}"), ("block", "one"), ("block", "two {0}{1}"), ("pre", ""), ("block", "1"), ("block", "2"), ("attr", "D"), ("attr", "i")]
    out = render_html(raw, blocks, translate(blocks)).decode()
    assert '<a href="u">l</a><img alt="T:i" src="s">' in out and "<h1>T:A <b>b</b> <code>c</code></h1>" in out and out.lower().startswith("<!doctype")
    both = render_html(raw, blocks, translate(blocks), "bi_inter").decode()
    assert '<td>T:1</td><td class="bilingual-src">1</td>' in both
    table = render_html(raw, blocks, translate(blocks), "bi_table").decode()
    assert table.count("<tr>") == 9
    assert [b.text for b in parse_html(render_html(raw, blocks, {}))] == [b.text for b in blocks]


def test_html_readings():
    raw = "<p>彼は<ruby>一廣<rt>かずひろ</rt></ruby>だ</p>".encode()
    assert parse_html(raw, lang="zh")[0].text == "彼は一廣かずひろだ"
    blocks = parse_html(raw, lang="ja")
    assert blocks[0].text == "彼は一廣{r0}だ"
    assert "<ruby>Kazu<rt>かずひろ</rt></ruby>" in render_html(raw, blocks, {0: "He is Kazu{r0}."}, lang="ja").decode()


def test_docx():
    raw = new_docx([paragraph("Head", 1), paragraph("body"), paragraph("")])
    blocks = parse_docx(raw)
    assert [(b.text, b.is_heading, b.translatable) for b in blocks] == [("Head", True, True), ("body", False, True), ("", False, False)]
    assert [b.text for b in parse_docx(render_docx(raw, blocks, {1: "neu"}, "bi_inter"))] == ["Head", "Head", "neu", "body", ""]
    assert [b.text for b in parse_docx(render_docx(raw, blocks, {1: "neu"}, "bi_table"))] == ["原文", "译文", "Head", "Head", "body", "neu"]
    with pytest.raises(FormatError):
        parse_docx(b"nope")


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("image.png", b"\x89PNG")
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ("a", "b"))
        z.writestr("OEBPS/c.opf", f'<package xmlns="urn:p"><manifest>{items}</manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        for i in ("a", "b"):
            z.writestr(f"OEBPS/{i}.xhtml", f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><body><p>{i} text<br/></p></body></html>')
    return out.getvalue()


def test_epub():
    raw = epub()
    blocks = parse_epub(raw)
    assert [(b.seq, b.text) for b in blocks] == [(0, "b text{0}"), (1, "a text{0}")]
    new = render_epub(raw, blocks, translate(blocks))
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("image.png") == b"\x89PNG"
        text = z.read("OEBPS/b.xhtml").decode()
    assert text.startswith('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">') and "<p>T:b text<br/></p>" in text
    with pytest.raises(FormatError):
        render_epub(raw, blocks, {}, "bi_table")


def test_img():
    blocks = parse_img(b"", backend=lambda path, raw, lang: ["eins", " ", "zwei"])
    assert [b.text for b in blocks] == ["eins", "zwei"]
    assert render_img(b"", blocks, {1: "two"}, "bi_inter").decode() == "eins\neins\n\nzwei\ntwo\n\n"
    with pytest.raises(FormatError):
        parse_img(b"")


def test_source_isolates_bad_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "sub" / "b.md").write_bytes(b"\0bad")
    (tmp_path / "c.bin").write_text("ignored")
    out = S.parse_files(S.read_files(spark, str(tmp_path)))
    rows = {(r.path.rsplit("/", 1)[1], r.seq): r for r in out.collect()}
    assert set(rows) == {("a.txt", 0), ("a.txt", 1), ("b.md", None)} and "binary" in rows["b.md", None].error
    order = spark.createDataFrame([(p,) for p in ("page_10.png", "page_2.png", "cover.png", "page_1.png")], "p string").orderBy(S.folder_order(F.col("p")))
    assert [r.p for r in order.collect()] == ["cover.png", "page_1.png", "page_2.png", "page_10.png"]


def test_a_task_holds_one_file_as_an_object(spark):
    def lists(path, raw, lang):
        import gc

        return [str(max([len(x) for x in gc.get_objects() if type(x) is list and x and type(x[0]) is bytes and len(x[0]) == 5000], default=0))]

    files = spark.range(0, 2000, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".png")).alias("path"), F.repeat(F.lit("x"), 5000).cast("binary").alias("content"))
    held = S.parse_files(files, backend=lists).groupBy().agg(F.count("*").alias("n"), F.max(F.col("src_text").cast("int")).alias("held")).first()
    assert held.n == 2000 and held.held <= 1


def test_results_are_passed_on_in_bounded_batches(spark):
    big = S.by_row(spark.range(0, 200, 1, 1), lambda i: [(100_000, {"i": i, "x": b"x" * 100_000})], "i long, x binary")
    sizes = big.mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    rows = [r.n for r in sizes.collect()]
    assert sum(rows) == 200 and max(rows) * 100_000 <= 5 * S.HELD


def test_a_task_gets_bounded_pieces_of_its_input(spark):
    import pyarrow as pa

    def one(path, content):
        yield 8, {"held": pa.total_allocated_bytes()}

    files = spark.range(0, 1000, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".srt")).alias("path"), F.repeat(F.lit("x"), 100_000).cast("binary").alias("content"))
    held = [r.held for r in S.by_row(files, one, "held long").collect()]
    assert len(held) == 1000 and max(held) <= 5 * 4 * S.HELD, "of 100 MB"


def test_lines_of_subtitles_are_counted_once():
    from textloom.sources import lines

    class Text(str):
        counted = 0

        def count(self, x, *span):
            Text.counted += span[1] - span[0]
            return str.count(self, x, *span)

    text = Text("x\n" + "".join(f"{i}\n00:00:01,000 --> 00:00:02,000\nline {i}\nmore\n\n\n" for i in range(500)))
    found = [(head and head["number"], own, rest) for head, own, rest in lines._cues(text)]
    assert found == [(None, [], ["x"]), *((str(i), [f"line {i}", "more"], [""] * 2) for i in range(500))]
    assert Text.counted <= len(text)


def test_only_the_columns_that_are_asked_for_are_made(spark):
    rows = [("a.md", b"# t\n\nx `y` z\n\n- w"), ("b.txt", b"one\n\n" + b"x" * 1600), ("c.bin", b"q"), ("d.txt", b"\0"), ("e.txt", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    whole = S.parse_files(files)
    for columns in (["path", "seq", "src_hash"], ["src_text", "path"], ["error", "content_hash", "slots"], whole.columns):
        some = S.parse_files(files, columns=columns)
        assert some.columns == columns
        assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(*columns).collect()))
    from textloom.plans import files as P

    plan = P.blocks_of(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "src_text#" in plan and not any(f"{c}#" in plan for c in ("slots", "ruby", "extra", "kind", "content_hash"))


def test_new_docx_is_written_without_a_tree(monkeypatch):
    from textloom.sources import packages

    monkeypatch.setattr(packages, "_run", None)
    texts = ["a & b < c > d \"e\" 'f'", "", "]]>", "漢字"]
    raw = new_docx([paragraph(texts[0], 1), *map(paragraph, texts), packages._table([(t, t) for t in texts])])
    assert [(b.text, b.is_heading) for b in parse_docx(raw)] == [(texts[0], True), *((t, False) for t in texts), *((t, False) for t in texts for _ in "ab")]


def test_elements_are_listed_without_recursion_and_lines_not_counted():
    from textloom.sources import markup

    deep = root = markup.Node("#root")
    for i in range(5000):
        deep.children += [markup.Node("b", {"n": str(i)}), "x", markup.Node("i")]
        deep = deep.children[0]
    assert [n.attrs["n"] for n in root.walk() if n.attrs] == list(map(str, range(5000)))
    assert [n.tag for n in root.walk()] == ["#root", *"b" * 5000, *"i" * 5000]
    tokenizer = markup._Builder()
    tokenizer.feed("a\n<p>\nb")
    assert tokenizer.getpos() == (1, 0) and not hasattr(root, "__dict__")


def test_trees_are_parsed_once(monkeypatch):
    from textloom.plans import files as P
    from textloom.sources import markup, packages

    fed = []
    monkeypatch.setattr(markup._Builder, "feed", lambda self, text, feed=markup._Builder.feed: (fed.append(text), feed(self, text)))
    raw = P._epub("Title", ["one", "two"])
    out = packages.render_epub(raw, [], {0: "T:Title", 1: "T:<b>one</b>"})
    assert len(fed) == 3, "two chapters, and the one target that has marks"
    assert [b.text for b in packages.parse_epub(out)] == ["T:Title", "T:<b>one</b>", "two"]


def test_native_lines_match_parser(spark):
    texts = ["a\n\nb\n", "x" * 3500 + ". " + "y" * 10, "\r\nq\r\n", "", "z\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.seq, r.src_text, r.translatable) for r in S.sequenced(S.line_segments(docs)).orderBy("doc_id", "seq").collect()]
    want = [(i, b.seq, b.text, b.translatable) for i, t in enumerate(texts) for b in (parse_txt(t.encode()) or [])]
    assert [g for g in got if g[0] != 3] == [w for w in want if w[0] != 3]


def test_glossary_files(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_bytes("﻿源语言,目标语,注释\n灵石,spirit stone|x|y|z,货币\n,q,\n金丹期,Golden Core\n".encode())
    g = S.load_glossary(spark, str(p))
    assert [tuple(r) for r in g.orderBy("ord").collect()] == [(0, "灵石", ["spirit stone", "x", "y"], "货币"), (1, "金丹期", ["Golden Core"], "")]
    for name in ("out.csv", "out.txt"):
        S.save_glossary(g, str(tmp_path / name))
        again = S.load_glossary(spark, str(tmp_path / name))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, g.collect()))
    assert '"src":"灵石"' in S.payload(g).first()[0]
