"""Properties of readers and renderers on generated documents."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.functions import plain as P
from textloom.sources.lines import parse_srt, parse_txt, render_srt, render_txt
from textloom.sources.markdown import parse_md, render_md
from textloom.sources.markup import build, parse_html, render_html, serialize

#: Without braces: a text that holds {0} itself can't be told from a slot, which is part of the notation.
LINE = st.text(alphabet="aB1 .。!-#>*|`[]()<>/=~_\t漢《》（）", max_size=12)
LINES = st.lists(st.one_of(LINE, st.sampled_from(["", "1", "00:00:01,000 --> 00:00:02,000", "---", "# t", "- x", "  y", "```", "> q", "|a|b|", "|-|-|", "    code", "<div>", "===", "1. z", "一廣《かずひろ》"])), max_size=14)
MANY = settings(max_examples=150, derandomize=True, deadline=None, suppress_health_check=[HealthCheck.too_slow])


@MANY
@given(LINES, st.sampled_from(["\n", "\r\n"]), st.sampled_from(["", "ja", "zh"]))
def test_untranslated_output_is_the_input(lines, eol, lang):
    raw = eol.join(lines).encode()
    for parse, render in ((parse_txt, render_txt), (parse_srt, render_srt), (parse_md, render_md)):
        blocks = parse(raw, lang=lang)
        assert [b.seq for b in blocks] == list(range(len(blocks)))
        assert parse(raw, lang=lang) == blocks
        out = render(raw, blocks, {}).decode()
        if lang == "ja":
            continue  # readings may be written in another form
        if parse is parse_srt:
            assert out == raw.decode()
        else:  # parts of latin paragraphs are stripped when they are joined
            bare = lambda t: [x.strip() for x in t.replace("\r\n", "\n").rstrip("\n").split("\n")]
            assert bare(out) == bare(raw.decode())


@MANY
@given(st.text(alphabet="ab。. \n!", max_size=200), st.integers(3, 30))
def test_parts_join_to_the_text(text, limit):
    parts = P.split_long(text, limit)
    assert "".join(parts) == text and all(len(p) <= limit for p in parts)


@MANY
@given(st.text(alphabet="a`$x[]()! {}0", max_size=40))
def test_slots_round_trip(text):
    hidden, kept = P.protect(text, [r"`[^`\n]+`", r"\$[^$\n]+\$"])
    if not P.SLOT.search(text):
        assert P.restore(hidden, kept) == text


@MANY
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "a & b", "<li>", "<ul>", "</ul>", "<br>", "<td>", "<table>", "</table>", "<!-- c -->", "<a href='x'>", "</a>", "<div>", "</div>", "text"]), max_size=14))
def test_html_is_stable(parts):
    once = serialize(build("".join(parts)))
    assert serialize(build(once)) == once
    blocks = parse_html(once.encode())
    again = parse_html(render_html(once.encode(), blocks, {}))
    assert [b.text for b in again] == [b.text for b in blocks]
