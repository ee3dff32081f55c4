"""Translated patterns: Java's engine must replace what Python's does."""

from __future__ import annotations

import random
import re

import pytest

from textloom.functions.patterns import PatternError, java_pattern, java_template

TEXTS = ["", "a", "ab\n", "Abc 12\nx_y", "aaa-bbb", "日本 語1２", "É é\x1c_​", "x\r\ny\n\n", "a.b$c\\d", "ab" * 5, "\n", "foo bar, foo. Foo"]


def java_sub(jvm, pattern, template, text):
    return jvm.java.util.regex.Pattern.compile(pattern).matcher(text).replaceAll(template)


def same(jvm, pattern, template="<\\g<0>>", flags=0):
    found, put = java_pattern(pattern, flags), java_template(template, pattern, flags)
    for text in TEXTS:
        assert java_sub(jvm, found, put, text) == re.sub(pattern, template, text, flags=flags), (pattern, text, found)


FIXED = [
    r"(?P<x>\w+)\s(?P=x)", r"\bfoo\b", r"\Boo", r"^.", r".$", r"(?m)^.", r"(?m).$", r"(?m)^$", r"\Z", r"\A\w", r"(?s).+", r"(?i)foo", r"(?i:F)oo", r"(?i)F(?-i:oo)", r"[^\W\d]+", r"[\D]", r"[^\D1]", r"\S+|\s", r"(a)|(b)", r"(?:ab){2}", r"(?>a+)b", r"a++", r"a*?b", r"(?:a|b)*",
    r"(?<=o)o", r"(?<!f)o", r"o(?!o)", r"\d+", r"[a-c日]+", r"[]\-^]+", r"\.", r"\$", r"(a)?b", r"x*", r"(?x) a  b # note", r"é|\x41", r"a{,2}", r"(?P<n>a)(?P<m>b)?",
]


@pytest.mark.parametrize("pattern", FIXED)
def test_fixed_patterns(spark, pattern):
    same(spark._jvm, pattern)
    same(spark._jvm, pattern, flags=re.IGNORECASE)


def test_templates(spark):
    same(spark._jvm, r"(?P<one>\w)(\w)?", r"\g<one>\2\\$1\n")
    same(spark._jvm, r"(a)(b)?", r"\g<1>0\g<2>\\1")
    same(spark._jvm, r"(a)(b)?", "$1 {x} \\\\")
    for bad in (r"\3", r"\g<z>", "\\"):
        with pytest.raises(PatternError):
            java_template(bad, "(a)(b)")


@pytest.mark.parametrize("bad", ["(", "[a", r"(?P<x>a)(?P<x>b)", "*a", r"(?a)\w", r"(a)?(?(1)b|c)", "a*?", "^|a", "(?:b*|a)"])
def test_what_has_no_counterpart(bad):
    with pytest.raises(PatternError):
        java_pattern(bad)


def generated(rng, depth=0):
    atom = lambda: rng.choice(["a", "b", "o", r"\w", r"\d", r"\s", ".", "[ab]", "[^a]", r"[\w-]", r"[^\s,]", "é", r"\.", "日"])
    if depth > 2:
        return atom()
    kind = rng.randrange(8)
    inner = lambda: generated(rng, depth + 1)
    if kind == 0:
        return f"({inner()})"
    if kind == 1:
        return f"(?:{inner()}|{inner()})"
    if kind == 2:
        return f"(?:{inner()}){rng.choice(['+', '?', '{1,2}', '+?', '*'])}"
    if kind == 3:
        return rng.choice([r"\b", "^", "$", r"\B", "(?=a)", "(?!b)", "(?<=a)"]) + inner()
    return inner() + inner() if kind < 6 else atom()


def test_generated_patterns(spark):
    rng, tested = random.Random(12), 0
    for _ in range(400):
        pattern, flags = generated(rng), rng.choice([0, re.IGNORECASE, re.MULTILINE, re.DOTALL])
        try:
            java_pattern(pattern, flags)
        except PatternError as e:
            assert "nothing" in str(e)
            continue
        same(spark._jvm, pattern, flags=flags)
        tested += 1
    assert tested > 300
