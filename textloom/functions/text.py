"""Text functions as Spark columns.

All of them stay inside the JVM. Character classes are spelled out where Java and the Unicode-aware
rules differ: ``SPACE`` is the full Unicode white-space set, since Java's ``\\s`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for use inside a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = r"\u200b-\u200d\u2060\ufeff"
#: Slots of placeholders and readings, and character ranges.
SLOT = r"\{r?(\p{Nd}+)\}"
RUBY_SLOT = r"\{r\p{Nd}+\}"
HAN = r"[\u4e00-\u9fff]"
CJK = r"[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]"
#: Characters that close a quotation or bracket, and marks that end a sentence.
CLOSERS = "」』”）\"’'》〉〕"
ENDERS = "。！？；…!?"
BEFORE_PUNCTUATION = " +([，。！？；、）】》」』,.!?;:])"
MAX_CHARS = 1500


#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def src_hash(c: Column) -> Column:
    """SHA-256 of the stripped text, hex."""
    return F.sha2(strip(c).cast("binary"), 256)


def effectively_empty(c: Column) -> Column:
    """Nothing left without slots, white space and zero-width characters.

    Most texts are told by their first character that can't be part of either; only the others are taken apart.
    """
    text = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, SLOT, ""), f"[{SPACE}{INVISIBLE}]+", "")
    return ~text.rlike(f"[^{SPACE}{INVISIBLE}{{}}r\\p{{Nd}}]") & (bare == "")


def slots(c: Column) -> Column:
    """Numbers of the placeholder and reading slots, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SLOT), F.lit(1))


def slots_match(src: Column, tgt: Column) -> Column:
    return slots(src) == slots(tgt)


def has_ruby(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(RUBY_SLOT)


def ruby_enabled(lang: Column) -> Column:
    return F.substring_index(F.lower(strip(F.coalesce(lang, F.lit("")))), "-", 1) == "ja"


def mostly_latin(c: Column) -> Column:
    """Fewer than half of the characters are Han ideographs (kana count as the rest)."""
    return F.regexp_count(c, F.lit(HAN)) * 2 < F.length(c)


def normalize_eol(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_last_newline(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("\n")), F.left(c, F.length(c) - 1)).otherwise(c)


def eol_of(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


# ---- segmentation ----


def sentences(c: Column) -> Column:
    """The text cut after sentence ends: an ender with its closers, or a full stop with closers before white space or the end."""
    closers = "[" + CLOSERS.replace("\\", "") + "]*"
    ender = rf"(?:[{ENDERS}]{closers}|\.{closers}(?=[ \t\n\r]|\z))"
    return F.regexp_extract_all(c, F.lit(rf"(?s).*?{ender}|.+"), F.lit(0))


def _hard_cut(c: Column, limit: int) -> Column:
    pieces = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / limit).cast("int"))
    return F.transform(pieces, lambda i: F.substring(c, i * limit + 1, F.lit(limit)))


def split_long(c: Column, limit: int = MAX_CHARS) -> Column:
    """Parts of at most ``limit`` characters: sentences are gathered until they reach the limit, then cut hard."""

    def gather(acc: Column, s: Column) -> Column:
        buf = F.concat(acc["buf"], s)
        full = F.length(buf) >= limit
        return F.struct(F.when(full, F.concat(acc["parts"], _hard_cut(buf, limit))).otherwise(acc["parts"]).alias("parts"), F.when(full, F.lit("")).otherwise(buf).alias("buf"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buf"))
    folded = F.aggregate(sentences(c), start, gather, lambda a: F.when(a["buf"] != "", F.concat(a["parts"], F.array(a["buf"]))).otherwise(a["parts"]))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(folded)


def join_parts(parts: Column, latin: Column) -> Column:
    spaced = strip(F.array_join(F.transform(parts, strip), " "))
    return F.when(latin, spaced).otherwise(F.array_join(parts, ""))


# ---- slots: one pass from left to right ----


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a column used inside a lambda would be worked out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(c: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """The text as pieces in order: struct (gap, g0, ...), what is before a match and its groups; the groups of the last piece are null."""
    found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    return F.arrays_zip(F.split(c, pattern, -1).alias("gap"), *found)


def joined(parts: Column, value) -> Column:
    """Pieces put together again, with ``value(piece, place)`` after each gap but the last."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p["gap"], F.when(p["g0"].isNull(), "").otherwise(value(p, i)))), "")


def replace_each(c: Column, pattern: str, value) -> Column:
    """Replace every match by ``value(match)`` in one pass, so inserted text is never matched again."""
    return joined(pieces(c, pattern), lambda p, _: value(p["g0"]))


def by_slot(slot: Column, names: Column, values: Column) -> Column:
    """The value whose name is ``slot``, else null. Slots are mostly in the place that their number says; only others are searched for."""
    number = F.translate(slot, "{r}", "").try_cast("int")

    def at(place: Column) -> Column:
        there = place.between(1, F.size(names)) & (F.get(names, place - 1) == slot)
        other = F.nullif(F.array_position(names, slot), F.lit(0))
        return F.when(there, F.get(values, place - 1)).otherwise(F.get(values, other.cast("int") - 1))

    return bind(F.when(number < 1 << 30, number + 1).otherwise(0), at)


def restore(c: Column, protected: Column) -> Column:
    """Put protected fragments (map slot -> text) back; unknown slots stay."""
    known = F.struct(F.map_keys(protected).alias("names"), F.map_values(protected).alias("values"))
    return F.when(protected.isNull(), c).otherwise(bind(known, lambda k: replace_each(c, r"\{r?\p{Nd}+\}", lambda m: F.coalesce(by_slot(m, k["names"], k["values"]), m))))


def protect(c: Column, patterns: list[str]) -> Column:
    """Struct (text, slots): matches of each pattern in turn become {0}, {1}, ...; slots maps them to the text."""
    state = F.struct(c.alias("text"), F.create_map().cast("map<string,string>").alias("slots"))
    for p in patterns:
        state = _protected(state, p)
    return state


def _protected(state: Column, pattern: str) -> Column:
    """The state after one pattern; a match may hold slots of the patterns before, which are put back in what is kept."""

    def step(x: Column) -> Column:
        start = F.size(x["slots"])
        name = lambda i: F.concat(F.lit("{"), (start + i).cast("string"), F.lit("}"))
        hits = F.filter(x["parts"], lambda q: q["g0"].isNotNull())
        names, texts = F.transform(hits, lambda _, i: name(i)), F.transform(hits, lambda q: restore(q["g0"], x["slots"]))
        return F.struct(joined(x["parts"], lambda _, i: name(i)).alias("text"), F.map_concat(x["slots"], F.map_from_arrays(names, texts)).alias("slots"))

    return bind(state, lambda s: bind(F.struct(pieces(s["text"], pattern).alias("parts"), s["slots"].alias("slots")), step))


# ---- readings (ruby) ----


def strip_ruby_tokens(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, RUBY_SLOT, ""), BEFORE_PUNCTUATION, "$1")


def strip_ruby_markup(c: Column) -> Column:
    """Drop <rt> and <rp> with their content, other ruby tags, and slots."""
    bare = F.regexp_replace(c, r"(?is)<(r[tp])\b[^>]*>.*?</\1>|</?r(?:uby|[btp])\b[^>]*>", "")
    return strip_ruby_tokens(bare)


def rubyize_aozora(c: Column) -> Column:
    """Struct (text, entries) for base《reading》: the base stays, the reading becomes slot {rK}.

    A base is of 々〆, katakana, Han and ASCII letters and digits; the pattern names what else there is, since Java is slow with unions of small ranges.
    """
    letter = r"(?:\p{Alnum}|[^\x{a000}-\x{10ffff}\x00-\u3004\u3007-\u309f\u3100-\u4dff])"

    def entry(hit: Column, i: Column) -> Column:
        at = F.instr(hit, "《")
        parts = [F.concat(F.lit("{r"), i.cast("string"), F.lit("}")).alias("token"), F.left(hit, at - 1).alias("base"), hit.substr(at + 1, F.length(hit) - at - 1).alias("rt")]
        return F.when(hit.isNotNull(), F.struct(*parts, F.lit("aozora").alias("style")))

    def taken(parts: Column) -> Column:
        """Of the pieces, each with its entry; the last one has none."""
        text = F.transform(parts, lambda q: F.concat(q["gap"], F.coalesce(F.concat(q["e"]["base"], q["e"]["token"]), F.lit(""))))
        entries = F.transform(F.filter(parts, lambda q: q["e"].isNotNull()), lambda q: q["e"])
        return F.struct(F.array_join(text, "").alias("text"), entries.alias("entries"))

    marked = lambda parts: F.transform(parts, lambda p, i: F.struct(p["gap"], entry(p["g0"], i).alias("e")))
    return bind(marked(pieces(c, letter + r"{1,20}+《[^》\n]{1,30}+》")), taken)


def restore_ruby(c: Column, entries: Column, readings: Column | None = None, style: str | None = None) -> Column:
    """Slots back to 《reading》, or （reading） in paren style; ``readings`` (map slot -> text) wins where not empty."""

    def put_back(known: Column) -> Column:
        def value(token: Column, i: Column) -> Column:
            own = F.lit(None).cast("string") if readings is None else F.nullif(by_slot(token, known["own"], known["texts"]), F.lit(""))

            def shown(e: Column) -> Column:
                rt = F.coalesce(own, e["rt"])
                paren = F.lit(style == "paren") if style else e["style"] == "paren"
                return F.when(e.isNull(), token).when(paren, F.concat(F.lit("（"), rt, F.lit("）"))).otherwise(F.concat(F.lit("《"), rt, F.lit("》")))

            in_turn = F.when(F.get(known["names"], i) == token, F.get(known["entries"], i))  # as a text has them that was only split
            return bind(F.coalesce(in_turn, by_slot(token, known["names"], known["entries"])), shown)

        return joined(pieces(c, RUBY_SLOT), lambda p, i: value(p["g0"], i))

    own = [] if readings is None else [F.coalesce(F.map_keys(readings), F.array().cast("array<string>")).alias("own"), F.coalesce(F.map_values(readings), F.array().cast("array<string>")).alias("texts")]
    known = F.struct(F.transform(entries, lambda e: e["token"]).alias("names"), entries.alias("entries"), *own)
    return F.when(F.size(entries) > 0, bind(known, put_back)).otherwise(c)


# ---- terms ----


def candidates(raw: Column) -> Column:
    """Up to three candidates of an a|b|c list."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\|", -1), strip)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, 3)


def variants(word: Column) -> Column:
    """Lower-cased word, and its plurals when the last word is made of letters."""
    parts = F.filter(F.split(strip(F.lower(word)), f"[{SPACE}]+", -1), lambda p: p != "")
    w, last = strip(F.lower(word)), F.try_element_at(parts, F.lit(-1))
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    stem = F.when(head == "", last).otherwise(F.concat(head, F.lit(" "), last))
    alpha = last.rlike(r"\A\p{L}+\z")
    out = F.array(w, F.when(alpha, F.concat(stem, F.lit("s"))), F.when(alpha & last.rlike("(?:s|x|ch|sh)$"), F.concat(stem, F.lit("es"))))
    return F.when(w == "", F.array().cast("array<string>")).otherwise(F.filter(out, lambda v: v.isNotNull()))


def count_any(text: Column, words: Column) -> Column:
    """Non-overlapping occurrences of any of the words, ignoring case, longest first."""
    sized = F.transform(F.array_distinct(F.filter(words, lambda w: w != "")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    quoted = F.transform(F.array_sort(sized), lambda x: F.concat(F.lit("\\Q"), F.replace(x["w"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(quoted) > 0, F.regexp_count(text, F.concat(F.lit("(?iu)"), F.array_join(quoted, "|")))).otherwise(0)


def mentions(text: Column, cands: Column) -> Column:
    """Whether the lower-cased text has any candidate (plurals only extend it, so the word itself decides)."""
    return F.exists(cands, lambda c: (strip(c) != "") & F.contains(F.lower(text), F.lower(strip(c))))


def term_line(src: Column, cands: Column) -> Column:
    return F.concat(src, F.lit("\x1f"), F.array_join(cands, "|"))


# ---- search ----

def like(c: Column, search: str) -> Column:
    """LIKE %search% that folds ASCII case only; % and _ in the search are wildcards and there is no escape character.

    As the pattern is open at both ends, it is a search: Java's (?i) folds ASCII only.
    """
    import re

    def part(m) -> str:
        return {"%": ".*?", "_": "."}.get(m[0]) or "\\Q" + m[0].replace("\\E", "\\E\\\\E\\Q") + "\\E"

    return F.coalesce(c, F.lit("")).rlike("(?is)" + re.sub(r"[%_]|[^%_]+", part, search.strip("%") if set(search) != {"%"} else ""))


def quoted(find: str, case_sensitive: bool = False) -> str:
    """A pattern for Java that matches the text itself."""
    return ("" if case_sensitive else "(?iu)") + "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def snippet(text: Column, needle: Column, around: int = 20, head: int = 60) -> Column:
    """``around`` characters on either side of the first hit, else the first ``head``."""
    at = F.instr(text, needle)
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (needle != ""), text.substr(start, at + F.length(needle) + around - start)).otherwise(F.substring(text, 1, head))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs compare as numbers of any length: alternating runs of other and digit characters, a number led by how long it is."""
    runs = F.regexp_extract_all(F.concat(c, F.lit("")), F.lit(r"\p{Nd}+|\P{Nd}+"), F.lit(0))
    lead = F.when(c.rlike(r"\A\p{Nd}"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    number = lambda r: bind(F.regexp_replace(r, r"\A0+(?=\p{Nd})", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    return F.concat(lead, F.transform(runs, lambda r: F.when(r.rlike(r"\A\p{Nd}"), number(r)).otherwise(F.lower(r))))


# ---- estimates ----


def estimate_tokens(c: Column) -> Column:
    """1.1 per CJK character and one per four others, rounded down."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return F.floor(cjk * F.lit(1.1) + (F.length(c) - cjk) / F.lit(4.0)).cast("long")


def estimate_in(chars: Column, slide: int = 0) -> Column:
    return F.greatest(F.lit(0), F.floor(chars * F.lit(1.05) * F.lit(min(1.6, 1.2 + 0.05 * max(0, slide))))).cast("long")


def estimate_out(tokens_in: Column) -> Column:
    return F.floor(tokens_in * F.lit(1.3)).cast("long")


def run_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1e6)


# ---- tokenizers of term candidates ----

#: Words that are no term candidates in languages with spaces.
STOP_WORDS = (
    "the and for are but not you all can her was one our out his has have this that with from they will would there their "
    "what about which when your said into them then than some could were"
).split()
STOP_KATAKANA = ["ノ", "カ", "コ", "ソ", "ド", "ト"]


def latin_words(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z'\-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))


def katakana_runs(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"[\u30A0-\u30FF\u31F0-\u31FFー]{2,}"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(STOP_KATAKANA))


def han_bigrams(c: Column) -> Column:
    """Pairs of neighbouring Han characters once all other characters are dropped."""
    pairs = lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: F.concat(a, b))  # noqa: E731  the last one has no partner and is null
    return F.coalesce(bind(F.regexp_extract_all(c, F.lit(HAN), F.lit(0)), lambda x: F.filter(pairs(x), lambda p: p.isNotNull())), F.array().cast("array<string>"))
