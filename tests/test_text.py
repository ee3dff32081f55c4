"""Text functions as columns, against plain rules."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import plain as P
from textloom.functions import text as T


def values(spark, texts, *cols):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in rows]


WORDS = ["他运转功法，只觉丹田一热。", "直径 3.14 厘米。", "The old man smiled. ", "End.", "「好！」", "a.b", "?!", "…", "x" * 400, "\n", ".) "]


def chunks(text, limit):
    """The sentence rule character by character."""
    ends, i = [], 0
    while i < len(text):
        if text[i] in "。！？；….!?":
            j = i + 1
            while j < len(text) and text[j] in "」』”）\"’'》〉〕":
                j += 1
            if text[i] != "." or j == len(text) or text[j] in " \t\n\r":
                ends.append(j)
            i = j
        else:
            i += 1
    out, held, at = [], "", 0
    for e in [*ends, len(text)]:
        held, at = held + text[at:e], e
        if len(held) >= limit:
            out += [held[k : k + limit] for k in range(0, len(held), limit)]
            held = ""
    return ([text] if len(text) <= limit else out + ([held] if held else [])) or [text]


def test_split_long(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(60)] + ["", "他运转功法，只觉丹田一热。" * 120, "The old man smiled. " * 200 + "End."]
    for t, native in zip(texts, values(spark, texts, T.split_long(F.col("t"), 100))):
        assert native == P.split_long(t, 100) == chunks(t, 100)
        assert "".join(native) == t and all(len(p) <= 100 for p in native)
    assert [len(p) for p in P.split_long("他运转功法，只觉丹田一热。" * 120)] == [1500, 8, 52]
    assert not any(p.startswith("14") for p in P.split_long("直径 3.14 厘米。" * 300))


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(alphabet="ab。.!」 \n", max_size=80))
def test_split_long_plain(text):
    assert P.split_long(text, 10) == chunks(text, 10)


def test_strip_hash_empty(spark):
    texts = ["  a　", "\x1c b\x85", "", "​", "{0} {r1}﻿", "　正文。", "﻿x"]
    got = values(spark, texts, T.src_hash(F.col("t")), T.effectively_empty(F.col("t")))
    for t, (h, e) in zip(texts, got):
        assert h == hashlib.sha256(t.strip().encode()).hexdigest()
        assert e == P.effectively_empty(t)


def test_slots(spark):
    text = "see `x` and [l](http://u) $y `z`$"
    patterns = [r"`[^`\n]+`", r"\$[^$\n]+\$", r"(?<=\]\()[^)\s]+(?=\))"]
    native = values(spark, [text], T.protect(F.col("t"), patterns))[0]
    plain, kept = P.protect(text, patterns)
    assert native["text"] == plain and dict(native["slots"]) == kept
    back = values(spark, [plain], T.restore(F.col("t"), F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])))[0]
    assert back == text == P.restore(plain, kept)
    assert values(spark, ["{0}a{r1}"], T.slots_match(F.col("t"), F.lit("{r0}{1}")), T.slots_match(F.col("t"), F.lit("{1}{0}"))) == [(True, False)]


def test_ruby(spark):
    texts = ["僕は一廣《かずひろ》だ。", "魔法《まほう》と剣《けん》", "no", "《x》"]
    for t, got in zip(texts, values(spark, texts, T.rubyize_aozora(F.col("t")))):
        text, entries = P.rubyize(t)
        assert got["text"] == text and [r.asDict() for r in got["entries"]] == entries
    src = P.rubyize("一廣《かずひろ》だ")
    assert src[0] == "一廣{r0}だ" and P.restore_ruby(*src) == "一廣《かずひろ》だ"
    assert P.rubyize("漢字（かんじ）", loose=True)[0] == "漢字{r0}" and P.rubyize("漢字（かんじ）")[1] == []
    assert P.rubyize("<ruby><rb>基</rb><rp>(</rp><rt>もと</rt></ruby>", markup=True)[1] == [{"token": "{r0}", "base": "基", "rt": "もと", "style": "html"}]
    assert P.restore_ruby("彼の名は一廣{r0}だ", [{"token": "{r0}", "base": "一廣", "rt": "K", "style": "html"}]) == "彼の名は<ruby>一廣<rt>K</rt></ruby>だ"
    assert P.restore_ruby("!{r0}", [{"token": "{r0}", "base": "一", "rt": "K", "style": "html"}]) == "!（K）"
    assert P.strip_ruby("<ruby>基<rt>x</rt></ruby>{r0} 。") == "基。"
    assert values(spark, ["<ruby>基<rt>x</rt></ruby>{r0} 。"], T.strip_ruby_markup(F.col("t"))) == ["基。"]
    e = F.array(F.struct(F.lit("{r0}").alias("token"), F.lit("一").alias("base"), F.lit("い").alias("rt"), F.lit("aozora").alias("style")))
    assert values(spark, ["一{r0}{r9}"], T.restore_ruby(F.col("t"), e), T.restore_ruby(F.col("t"), e, F.create_map(F.lit("{r0}"), F.lit("I"))), T.restore_ruby(F.col("t"), e, style="paren")) == [("一《い》{r9}", "一《I》{r9}", "一（い）{r9}")]
    assert P.ruby_enabled("ja-JP") and not P.ruby_enabled("zh-CN") and not P.ruby_enabled(None)


def test_bases_are_looked_for_before_brackets_only():
    """As by one pattern of base and brackets, which tries up to 20 characters from every place of a text without readings."""
    import re

    kept = {"aozora": r"([\u4e00-\u9fff々〆\u30A0-\u30FFーA-Za-z0-9]{1,20})《([^》\n]{1,30})》", "paren": r"([\u4e00-\u9fff々〆\u30A0-\u30FFー]{1,20})（([\u3040-\u30FFー]{1,30})）"}
    r, bits = random.Random(6), [*"aZ漢々ーカか 、\n《》（）", "漢" * 9, "カ" * 21, "《よみ》", "（よみ）", "か" * 31, "a《b《c》", "《》"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(16))) for _ in range(3000)]
    for style, read in P._NOTATIONS[1:]:
        assert any(re.search(kept[style], t) for t in texts)
        for t in texts:
            assert list(read(t)) == [(m.start(), m.end(), *m.groups()) for m in re.finditer(kept[style], t)]

    class Counted:
        tried: list = []

        def search(self, text, start, end):
            self.tried.append(end - start)
            return P._AOZORA[0].search(text, start, end)

    found = list(P._bracketed(Counted(), *P._AOZORA[1:], "漢" * 100_000 + "字《じ》" + "x" * 100_000))
    assert found == [(99_981, 100_004, "漢" * 19 + "字", "じ")] and Counted.tried == [20]


def test_readings_take_few_steps_and_give_the_same(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("aZ9々〆ーカ漢龥𠀀あ- 《》《》\n") for _ in range(r.randrange(90))) + "x" * r.randrange(30) + "《よみ》" for _ in range(300)]
    for t, got in zip(texts, values(spark, texts, T.rubyize_aozora(F.col("t")))):
        text, entries = P.rubyize(t)
        assert got["text"] == text and [e.asDict() for e in got["entries"]] == entries
    mixed = [("{r1}b{r0}{r01}", "《い》b《あ》{r01}"), ("{r9}{r2147483647}{r99999999999}{r٣}", "{r9}{r2147483647}{r99999999999}{r٣}")]
    rows = spark.createDataFrame([(t, [(f"{{r{i}}}", "", x, "aozora") for i, x in enumerate("あい")]) for t, _ in mixed], "t string, e array<struct<token:string,base:string,rt:string,style:string>>")
    back = rows.select("t", T.restore_ruby(F.col("t"), F.col("e")).alias("b"))
    assert sorted(map(tuple, back.collect())) == sorted(mixed)
    assert back._jdf.queryExecution().analyzed().toString().count("array_position") == 1, "an entry is looked up once for a slot"


def test_markup_of_readings_goes(spark):
    texts = ["<ruby>基<rp>(</rp><rt lang='x'>もと</rt><RP>)</rp></ruby> a", "<rt>open", "x</rt>y<rb>z", "<ruby>a<rt>b<rt>c</rt>d</ruby>", "<rp><rt>x</rp>y</rt>z", "a < b <rtx>", "<ruby>基<rt>x\ny</rt></ruby>{r0} 。"]
    want = ["基 a", "open", "xyz", "ad", "yz", "a < b <rtx>", "基。"]
    assert [P.strip_ruby(t) for t in texts] == want == values(spark, texts, T.strip_ruby_markup(F.col("t")))


def test_slot_functions_take_linear_time(spark):
    """Twice the text, about twice the time: nothing is worked out again for each match."""
    import time

    def took(n, make, column):
        df = spark.createDataFrame([(make * n,)], "t string").cache()
        df.count()
        best = 9e9
        for _ in range(2):
            began = time.monotonic()
            df.select(F.length(F.to_json(F.struct(column.alias("x"))))).collect()
            best = min(best, time.monotonic() - began)
        return best

    c = F.col("t")
    for make, column in (("天地", T.han_bigrams(c)), ("a `x` ", T.bind(T.protect(c, [r"`[^`\n]+`"]), lambda p: T.restore(p["text"], p["slots"]))), ("漢《かん》だ", T.bind(T.rubyize_aozora(c), lambda p: T.restore_ruby(p["text"], p["entries"])))):
        assert took(32_000, make, column) < 6 * max(took(8_000, make, column), 0.4)


def test_natural_order_of_long_numbers(spark):
    names = ["a" + "9" * 41, "a1" + "0" * 41, "a007", "a7", "a10", "a0", "7", "é2"]
    keys = dict(zip(names, values(spark, names, T.natural_key(F.col("t")))))
    assert sorted(["a10", "a" + "9" * 41, "a1" + "0" * 41, "a7", "a0"], key=keys.get) == ["a0", "a7", "a10", "a" + "9" * 41, "a1" + "0" * 41]
    assert keys["a007"] == keys["a7"]


def test_terms(spark):
    assert values(spark, ["Spirit Stone", "box", "x1", " "], T.variants(F.col("t"))) == [["spirit stone", "spirit stones"], ["box", "boxs", "boxes"], ["x1"], []]
    assert values(spark, ["Spirit Stones and spirit stone"], T.count_any(F.col("t"), T.variants(F.lit("spirit stone")))) == [2]
    assert values(spark, ["a.b A.B axb"], T.count_any(F.col("t"), F.array(F.lit("a.b")))) == [2]
    assert values(spark, [" a | |b|c|d"], T.candidates(F.col("t"))) == [["a", "b", "c"]]
    assert values(spark, ["page_10", "page_2", "cover", "Page_02"], T.natural_key(F.col("t")))[0] > values(spark, ["page_2"], T.natural_key(F.col("t")))[0]
    assert values(spark, ["カズヒホはマリーと魔法学校"], T.katakana_runs(F.col("t")), T.han_bigrams(F.col("t"))) == [(["カズヒホ", "マリー"], ["魔法", "法学", "学校"])]


def test_search(spark):
    assert values(spark, ["ABC", "a\\c", "Äbc", None], T.like(F.col("t"), "%b_"), T.like(F.col("t"), "\\")) == [(True, False), (False, True), (True, False), (False, False)]
    assert values(spark, ["x needle y"], T.snippet(F.col("t"), F.lit("needle"), 2), T.snippet(F.col("t"), F.lit("zz"), 2, 3)) == [("x needle y", "x n")]


def test_estimates(spark):
    assert values(spark, ["灵石abcd"], T.estimate_tokens(F.col("t"))) == [3]
    row = spark.range(1).select(T.estimate_in(F.lit(1000), 0).alias("a"), T.estimate_in(F.lit(1000), 20).alias("b")).first()
    assert (row.a, row.b) == (int(1000 * 1.05 * 1.2), int(1000 * 1.05 * 1.6))


@pytest.mark.parametrize(("code", "want"), [("ja-JP", "japan"), ("ZH", "ch"), ("xx", "ch"), (None, "ch")])
def test_languages(spark, code, want):
    from textloom.operators.runs import language_label, recognition_model

    row = spark.range(1).select(recognition_model(F.lit(code).cast("string")).alias("m"), language_label(F.lit("ja-JP")).alias("l"), language_label(F.lit("xx")).alias("x")).first()
    assert (row.m, row.l, row.x) == (want, "ja-JP（日语-日本）", "xx")
