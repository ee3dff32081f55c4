"""Patterns of Python's ``re`` for Java's engine, translated from the parse tree.

Classes follow Python's idea of digits, word characters and white space in all of Unicode; ends of text and line, word borders and the dot are
spelled out, because Java's own differ. What has no counterpart is an error when the pattern is made, not other rows.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

from textloom.functions.text import SPACE


class PatternError(ValueError):
    """The pattern or template is wrong, or Java has nothing like it."""


_SETS = {"DIGIT": r"\p{Nd}", "WORD": r"\p{L}\p{N}_", "SPACE": SPACE}
_WORD = f"[{_SETS['WORD']}]"
_PLACES = {
    "AT_BEGINNING": r"(?<![\s\S])", "AT_BEGINNING_STRING": r"(?<![\s\S])", "AT_BEGINNING_LINE": r"(?<![^\n])",
    "AT_END": r"(?=\n?(?![\s\S]))", "AT_END_STRING": r"(?![\s\S])", "AT_END_LINE": r"(?![^\n])",
    "AT_BOUNDARY": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "AT_NON_BOUNDARY": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}"


def _class(items: list) -> str:
    negated = bool(items) and items[0][0] is C.NEGATE
    parts = []
    for op, value in items[negated:]:
        if op is C.LITERAL:
            parts.append(_char(value))
        elif op is C.RANGE:
            parts.append(f"{_char(value[0])}-{_char(value[1])}")
        elif op is C.CATEGORY:
            name = str(value).removeprefix("CATEGORY_")
            parts.append(f"[^{_SETS[name.removeprefix('NOT_')]}]" if name.startswith("NOT_") else _SETS[name])
        else:
            raise PatternError(f"{op} in a class")
    return f"[{'^' if negated else ''}{''.join(parts)}]" if not negated or not any(p.startswith("[^") for p in parts) else f"(?![{''.join(parts)}])[\\s\\S]"


class _Writer:
    def __init__(self, flags: int):
        self.flags = flags

    def sequence(self, items) -> str:
        return "".join(self.item(op, value) for op, value in items)

    def within(self, add: int, drop: int, items) -> str:
        """A part with flags of its own."""
        before, self.flags = self.flags, (self.flags | add) & ~drop
        text = self.sequence(items)
        changed = (before ^ self.flags) & re.IGNORECASE
        folds, self.flags = bool(self.flags & re.IGNORECASE), before
        return f"(?{'iu' if folds else '-iu'}:{text})" if changed else text

    def item(self, op, value) -> str:
        match str(op):
            case "LITERAL":
                return _char(value)
            case "NOT_LITERAL":
                return f"[^{_char(value)}]"
            case "ANY":
                return r"[\s\S]" if self.flags & re.DOTALL else r"[^\n]"
            case "IN":
                return _class(value)
            case "BRANCH":
                return f"(?:{'|'.join(self.sequence(x) for x in value[1])})"
            case "SUBPATTERN":
                number, add, drop, items = value
                return f"({'?:' if number is None else ''}{self.within(add, drop, items)})"
            case "ATOMIC_GROUP":
                return f"(?>{self.sequence(value)})"
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                least, most, items = value
                how = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}[str(op)]
                return f"(?:{self.sequence(items)}){{{least},{'' if most is C.MAXREPEAT else most}}}{how}"
            case "ASSERT" | "ASSERT_NOT":
                direction, items = value
                return f"(?{'<' if direction < 0 else ''}{'=' if str(op) == 'ASSERT' else '!'}{self.sequence(items)})"
            case "AT":
                name = str(value)
                if self.flags & re.MULTILINE and name in ("AT_BEGINNING", "AT_END"):
                    name += "_LINE"
                return _PLACES[name]
            case "GROUPREF":
                return f"(?:\\{value})"
        raise PatternError(f"{op} has no counterpart")


def _may_prefer_nothing(items) -> bool:
    """Whether some part can match nothing though it could match more at the same place: an alternative or a short repetition that may be empty."""
    for op, value in items:
        inner = {"BRANCH": lambda v: v[1], "SUBPATTERN": lambda v: [v[3]], "ATOMIC_GROUP": lambda v: [v]}.get(str(op), lambda v: [v[2]] if "REPEAT" in str(op) else [])(value)
        if str(op) == "BRANCH" and min(x.getwidth()[0] for x in inner) == 0 or str(op) == "MIN_REPEAT" and value[0] == 0:
            return True
        if any(map(_may_prefer_nothing, inner)):
            return True
    return False


def java_pattern(pattern: str, flags: int = 0) -> str:
    """A pattern for Java that matches what ``re.compile(pattern, flags)`` matches.

    After an empty match, Python looks for a longer one at the same place and Java goes on; so a pattern that may prefer an empty match is an error.
    """
    try:
        tree = parser.parse(pattern, flags)
    except re.error as e:
        raise PatternError(str(e)) from e
    whole = tree.state.flags
    if whole & (re.ASCII | re.LOCALE):
        raise PatternError("ASCII and LOCALE patterns aren't supported")
    if tree.getwidth()[0] == 0 and _may_prefer_nothing(tree):
        raise PatternError("the pattern may match nothing where it could match something")
    writer = _Writer(whole)
    return ("(?iu)" if whole & re.IGNORECASE else "") + writer.sequence(tree)


def java_template(template: str, pattern: str, flags: int = 0) -> str:
    """A replacement for Java that does what the template does for ``re.sub`` with that pattern."""
    try:
        parts = parser.parse_template(template, re.compile(pattern, flags))
    except (re.error, IndexError) as e:
        raise PatternError(str(e)) from e
    out, after_group = [], False
    for part in parts:
        if isinstance(part, int):
            out.append(f"${part}")
            after_group = True
        elif part:
            plain = re.sub(r"([\\$])", r"\\\1", part)
            out.append("\\" + plain if after_group and plain[0].isdigit() else plain)  # else the digit would belong to the number
            after_group = False
    return "".join(out)
