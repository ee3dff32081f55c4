"""HTML on a small element tree built with the standard library's tokenizer."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from itertools import groupby

from textloom.functions.plain import Block, FormatError, decode, effectively_empty, reading_pieces, restore_ruby, ruby_enabled, split_long
from textloom.sources.lines import final, paragraphs

#: Fixed values. Elements that hold one paragraph of text; a div does if it has none of them inside.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "figcaption", "dt", "dd", "title"}
#: Fixed values. Elements that stay whole, behind a slot.
WHOLE = {"code", "img", "br", "svg", "iframe", "script", "style", "input", "pre", "audio", "video", "canvas", "a"}
#: Fixed values. Inline elements that stay in the text as bare tags.
INLINE = {"b", "i", "em", "strong", "span", "sub", "sup", "u", "mark", "small", "abbr"}
ATTRIBUTES = ("alt", "title", "placeholder")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag closes an open element of these kinds, unless one of the stops lies between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: What an open paragraph isn't closed across.
_HOLDS_P = {"table", "td", "th", "li", "button", "div", "section", "article", "blockquote"}
_P = {"p"}
_SPLIT = re.compile(r"(\{r?\d+\})")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str; a Node with tag "!" holds raw markup such as a comment

    def walk(self):
        """All elements in document order, however deep."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag != "!")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, kinds: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in kinds:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close(_P, _HOLDS_P)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def updatepos(self, i, j):
        """Lines aren't counted, as nothing asks where a tag stands."""
        return j

    def handle_data(self, data):
        into = self.open[-1].children
        if into and isinstance(into[-1], str):
            into[-1] += data
        else:
            into.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Node("!", {"raw": f"<!--{data}-->"}))

    def handle_decl(self, decl):
        self.open[-1].children.append(Node("!", {"raw": f"<!{decl}>"}))

    def handle_pi(self, data):
        self.open[-1].children.append(Node("!", {"raw": f"<?{data}>"}))


def build(text: str) -> Node:
    if "<" not in text and "&" not in text:  # nothing to tokenize
        return Node("#root", {}, [text] if text else [])
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def serialize(node: Node, xml: bool = False) -> str:
    out: list[str] = []

    def put(n) -> None:
        if isinstance(n, str):
            out.append(escape(n, quote=False))
        elif n.tag == "!":
            out.append(n.attrs["raw"])
        elif n.tag == "#root":
            for c in n.children:
                put(c)
        else:
            attrs = "".join(f" {k}" if v is None and not xml else f' {k}="{escape(v if v is not None else k)}"' for k, v in n.attrs.items())
            if n.tag in VOID or xml and not n.children:
                out.append(f"<{n.tag}{attrs}{'/' if xml else ''}>")
                return
            out.append(f"<{n.tag}{attrs}>")
            for c in n.children:
                if n.tag in ("script", "style") and isinstance(c, str) and not xml:
                    out.append(c)
                else:
                    put(c)
            out.append(f"</{n.tag}>")

    put(node)
    return "".join(out)


def leaf_blocks(root: Node) -> list[tuple[Node, Node]]:
    """(parent, element) in document order."""
    found: list[tuple[Node, Node]] = []

    def look(parent: Node) -> None:
        for c in parent.children:
            if not isinstance(c, Node) or c.tag == "!":
                continue
            if c.tag == "pre":
                found.append((parent, c))
            elif c.tag in WHOLE:
                continue
            elif (c.tag in BLOCKS or c.tag == "div") and not any(d.tag in BLOCKS for d in c.walk() if d is not c):
                found.append((parent, c))
            else:
                look(c)

    look(root)
    return found


def _reading(node: Node) -> tuple[str, str]:
    rt = "".join(x if isinstance(x, str) else "" for c in node.children if isinstance(c, Node) and c.tag == "rt" for x in c.children[:1])
    base = "".join(c if isinstance(c, str) else c.text() for c in node.children if isinstance(c, str) or c.tag not in ("rt", "rp", "!"))
    return base, rt


def flatten(element: Node, ruby_on: bool) -> tuple[str, dict[str, Node], list[dict]]:
    """(text with slots and bare inline tags, slot -> element, readings)."""
    held: dict[str, Node] = {}
    ruby: list[dict] = []

    def flat(node: Node) -> str:
        out = ""
        for c in node.children:
            if isinstance(c, str):
                out += c
            elif c.tag == "!":
                continue
            elif ruby_on and c.tag == "ruby":
                base, rt = _reading(c)
                ruby.append({"token": f"{{r{len(ruby)}}}", "base": base, "rt": rt, "style": "html"})
                out += base + ruby[-1]["token"]
            elif c.tag in WHOLE:
                name = f"{{{len(held)}}}"
                held[name] = c
                out += name
            else:
                inner = flat(c)
                out += f"<{c.tag}>{inner}</{c.tag}>" if c.tag in INLINE else inner
        return out

    return flat(element), held, ruby


def _attributes(root: Node) -> list[tuple[Node, str]]:
    out = []
    for n in root.walk():
        if not n.attrs:
            continue
        names = [*ATTRIBUTES, *(["content"] if n.tag == "meta" and n.attrs.get("name") == "description" else [])]
        out += [(n, a) for a in names if n.tag != "!" and (n.attrs.get(a) or "").strip()]
    return out


def parse_tree(root: Node, ruby_on: bool, first: int = 0) -> list[Block]:
    """Paragraphs in document order, then attribute texts; ``first``: seq of the first block."""
    blocks: list[Block] = []

    def add(text: str, **more) -> None:
        blocks.append(Block(first + len(blocks), text, **more))

    for k, (_, el) in enumerate(leaf_blocks(root)):
        where = {"el": str(k)}
        if el.tag == "pre":
            add("", translatable=False, kind="pre", extra=where)
            continue
        text, held, ruby = flatten(el, ruby_on)
        if effectively_empty(text):
            add(text, translatable=False, kind="empty", extra=where)
            continue
        kept = {name: serialize(node) for name, node in held.items()}
        for i, part in enumerate(split_long(text)):
            add(part, is_heading=el.tag.startswith("h"), kind="block", para=k, part=i, slots=kept, ruby=ruby, extra=where)
    for node, name in _attributes(root):
        add(node.attrs[name], kind="attr", extra={"attr": name})
    return blocks


def parse_html(raw: bytes, lang: str = "", **_) -> list[Block]:
    return parse_tree(build(decode(raw)), ruby_enabled(lang))


def _opened(source: Node) -> list[Node | str]:
    """The children, with those of elements that carry no meaning in their place, and neighbouring strings as one; comments go."""
    out: list[Node | str] = []
    for c in source.children:
        if isinstance(c, Node):
            out += [] if c.tag == "!" else [c] if c.tag in INLINE or c.tag in ("code", "img", "br") else _opened(c)
        else:
            out.append(c)
    runs = groupby(out, lambda c: isinstance(c, str))
    return [x for text, some in runs for x in (["".join(some)] if text else some)]


def _fill(target: Node, source: Node, held: dict[str, Node], ruby: dict[str, dict], readings: dict[str, str]) -> None:
    """Rebuild translated content: slots become their elements, reading slots <ruby> around the word before them."""
    for c in _opened(source):
        if isinstance(c, Node):
            target.children.append(Node(c.tag, dict(c.attrs)))
            _fill(target.children[-1], c, held, ruby, readings)
            continue
        for piece in reading_pieces(c, ruby.values(), readings, lambda e: ""):
            if isinstance(piece, str):
                target.children += [copy.deepcopy(held[x]) if x in held else x for x in _SPLIT.split(piece) if x]
            else:
                word, rt = piece
                target.children.append(Node("ruby", {}, [word, Node("rt", {}, [rt])]))


def render_tree(root: Node, blocks: list[Block], done: dict[int, str], mode: str, readings: dict[int, dict], ruby_on: bool, xml: bool = False) -> str:
    """Write translations into the tree the blocks came from, and serialise it."""
    rows: list[tuple[str, str]] = []
    attrs = _attributes(root)
    places = leaf_blocks(root)
    texts = {k: flatten(el, ruby_on) for k, (_, el) in enumerate(places)}
    for (node, name), b in zip(attrs, (b for b in blocks if b.kind == "attr")):
        new = done.get(b.seq, b.text)
        rows.append((b.text, new))
        if mode != "bi_table":
            node.attrs[name] = new
    for group in paragraphs([b for b in blocks if b.kind == "block"]):
        b = group[0]
        src, tgt, found = final(group, done, readings)
        plain = [{**e, "style": "aozora"} for e in b.ruby]
        source = restore_ruby(src, plain)
        rows.append((source, restore_ruby(tgt, plain, found)))
        if mode == "bi_table":
            continue
        parent, el = places[b.para]
        _, held, _ = texts[b.para]
        el.children = []
        _fill(el, build(tgt), held, {e["token"]: e for e in b.ruby}, found)
        if mode == "bi_inter":
            at = next(i for i, c in enumerate(parent.children) if c is el)
            parent.children.insert(at + 1, Node("td" if parent.tag == "tr" else "p", {"class": "bilingual-src"}, [source]))
    if mode == "bi_table":
        cells = lambda tag, pair: Node("tr", {}, [Node(tag, {}, [x]) for x in pair])
        table = Node("table", {"border": "1"}, [cells("th", ("原文", "译文")), *(cells("td", r) for r in rows)])
        root = Node("html", {}, [Node("body", {}, [table])])
    return serialize(root, xml)


def render_html(raw: bytes, blocks: list[Block], done: dict[int, str], mode: str = "target", readings: dict[int, dict] | None = None, lang: str = "", **_) -> bytes:
    if mode not in ("target", "bi_inter", "bi_table"):
        raise FormatError(f"html has no mode {mode}")
    return render_tree(build(decode(raw)), blocks, done, mode, readings or {}, ruby_enabled(lang)).encode()
