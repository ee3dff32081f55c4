"""Markdown by a block scanner over lines (CommonMark blocks and tables; the outermost block counts)."""

from __future__ import annotations

import re

from textloom.functions.plain import Block, FormatError, decode, effectively_empty, normalize_eol, protect, restore, restore_ruby, ruby_enabled, rubyize, split_long
from textloom.sources.lines import final, paragraphs

#: Inline code, formulas, images, and the address of a link; the words of a link stay.
_KEEP = [r"`[^`\n]+`", r"\$[^$\n]+\$", r"!\[[^\]\n]*\]\([^)\n]*\)", r"(?<=\]\()[^)\s]+(?=\))"]
_PASS = {"frontmatter", "fence", "code_block", "html_block", "hr"}

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_HEADING = re.compile(r"^ {0,3}#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r"^ {0,3}>")
_ITEM = re.compile(r"^( {0,3})(?:([-+*])|(\d{1,9})([.)]))([ \t]+|$)")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(
    r"^ {0,3}<(?:!--|\?|![A-Za-z]|/?(?:address|article|aside|base|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset"
    r"|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[ \t>/]|$)"
    r"|(?:script|pre|style|textarea)(?:[ \t>]|$))",
    re.I,
)
_HTML_ALONE = re.compile(r"^ {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
_RAW_END = {"<!--": "-->", "<?": "?>"}


def _blank(line: str) -> bool:
    return not line.strip()


def _starts_block(lines: list[str], i: int) -> bool:
    """Whether line i ends a paragraph above it."""
    x = lines[i]
    item = _ITEM.match(x)
    if item and (item[3] in (None, "1")) and x[item.end() :].strip():
        return True
    return bool(_blank(x) or _HEADING.match(x) or _RULE.match(x) or _QUOTE.match(x) or _FENCE.match(x) or _HTML.match(x))


def _html_end(lines: list[str], i: int) -> int:
    head = lines[i].lstrip()
    raw = re.match(r"<(script|pre|style|textarea)\b", head, re.I)
    stop = next((e for s, e in _RAW_END.items() if head.startswith(s)), f"</{raw[1].lower()}>" if raw else ">" if re.match(r"<![A-Za-z]", head) else None)
    j = i
    if stop:
        while j < len(lines) and stop not in lines[j].lower():
            j += 1
        return min(j + 1, len(lines))
    while j < len(lines) and not _blank(lines[j]):
        j += 1
    return j


def _item_end(lines: list[str], i: int, width: int) -> int:
    """A list item goes on while lines are indented to its text, or continue its paragraph."""
    j, after_blank = i + 1, False
    while j < len(lines):
        x = lines[j]
        if _blank(x):
            after_blank = True
        elif len(x) - len(x.lstrip(" ")) >= width:
            after_blank = False
        elif after_blank or _starts_block(lines, j) or _ITEM.match(x):
            break
        j += 1
    while j > i + 1 and _blank(lines[j - 1]):
        j -= 1
    return j


def spans(lines: list[str]) -> list[tuple[int, int, str]]:
    """(first line, end, kind) of the outermost blocks; blank lines belong to none."""
    out: list[tuple[int, int, str]] = []
    i, n = 0, len(lines)
    if n and lines[0].strip() == "---":
        end = next((k for k in range(1, n) if lines[k].strip() in ("---", "...")), None)
        if end is not None:
            out.append((0, end + 1, "frontmatter"))
            i = end + 1
    while i < n:
        x = lines[i]
        if _blank(x):
            i += 1
            continue
        fence, item = _FENCE.match(x), _ITEM.match(x)
        if re.match(r"^(?: {4}|\t)", x):
            j = i
            while j < n and (_blank(lines[j]) or re.match(r"^(?: {4}|\t)", lines[j])):
                j += 1
            while _blank(lines[j - 1]):
                j -= 1
            kind = "code_block"
        elif fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            j = next((k + 1 for k in range(i + 1, n) if close.match(lines[k])), n)
            kind = "fence"
        elif _HEADING.match(x):
            j, kind = i + 1, "heading"
        elif _RULE.match(x):
            j, kind = i + 1, "hr"
        elif _QUOTE.match(x):
            j = i + 1
            while j < n and (_QUOTE.match(lines[j]) or not _starts_block(lines, j) and not _blank(lines[j - 1])):
                j += 1
            kind = "blockquote"
        elif item:
            j, kind = _item_end(lines, i, item.end() if x[item.end() :].strip() else item.end(4 if item[3] else 2) + 1), "list_item"
        elif _HTML.match(x) or _HTML_ALONE.match(x):
            j, kind = _html_end(lines, i), "html_block"
        elif "|" in x and i + 1 < n and "-" in lines[i + 1] and _TABLE_RULE.match(lines[i + 1]) and x.strip().strip("|").count("|") == lines[i + 1].strip().strip("|").count("|"):
            j = i + 2
            while j < n and not _starts_block(lines, j):
                j += 1
            kind = "table"
        else:
            j, kind = i + 1, "paragraph"
            while j < n:
                if _UNDERLINE.match(lines[j]):
                    j, kind = j + 1, "heading"
                    break
                if _starts_block(lines, j):
                    break
                j += 1
        out.append((i, j, kind))
        i = j
    return out


def parse_md(raw: bytes, lang: str = "", loose: bool = False, **_) -> list[Block]:
    lines = normalize_eol(decode(raw))[0].split("\n")
    blocks: list[Block] = []

    def verbatim(s: int, e: int, kind: str) -> None:
        if e > s:
            blocks.append(Block(len(blocks), "\n".join(lines[s:e]), translatable=False, kind=kind, extra={"s": str(s), "e": str(e)}))

    at = 0
    for para, (s, e, kind) in enumerate(spans(lines)):
        verbatim(at, s, "gap")
        at = e
        text, kept = protect("\n".join(lines[s:e]), _KEEP)
        text, ruby = rubyize(text, loose, markup=True) if ruby_enabled(lang) else (text, [])
        if kind in _PASS or effectively_empty(text):
            verbatim(s, e, kind if kind in _PASS else "empty")
            continue
        for k, part in enumerate(split_long(text)):
            blocks.append(Block(len(blocks), part, is_heading=kind == "heading", kind=kind, para=para, part=k, slots=kept, ruby=ruby, extra={"s": str(s), "e": str(e)}))
    verbatim(at, len(lines), "gap")
    return blocks


def table_cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", "<br>")


def render_md(raw: bytes, blocks: list[Block], done: dict[int, str], mode: str = "target", readings: dict[int, dict] | None = None, **_) -> bytes:
    if mode not in ("target", "bi_inter", "bi_table"):
        raise FormatError(f"md has no mode {mode}")
    text, eol = normalize_eol(decode(raw))
    total = text.count("\n") + 1
    out, rows = "", ["| 原文 | 译文 |", "|---|---|"]
    for group in paragraphs(blocks):
        b = group[0]
        tail = "\n" if int(b.extra["e"]) < total else ""
        if not b.translatable:
            out += b.text + tail
            continue
        src, tgt, found = final(group, done, readings or {})
        src, tgt = restore_ruby(restore(src, b.slots), b.ruby), restore_ruby(restore(tgt, b.slots), b.ruby, found)
        out += (tgt if mode == "target" else f"{src}\n\n{tgt}") + tail
        rows.append(f"| {table_cell(src)} | {table_cell(tgt)} |")
    if mode == "bi_table":
        return ("\n".join(rows) + "\n").encode()
    if out and not out.endswith("\n"):
        out += "\n"
    return (out.replace("\n", eol)).encode()
