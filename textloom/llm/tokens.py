"""Token ids by a public tokenizer file, with a cache of words.

``WordEncoder.encode`` returns exactly what ``Tokenizer.encode(text, add_special_tokens=False).ids``
returns. Both supported files split a text into pieces first and merge inside a piece only, so the
ids of a piece can be kept. The short way is taken only for texts whose characters all lie in a range where the
splitting rule has one meaning; all others, and texts with special tokens, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

import numpy as np

#: Characters below U+0250 without controls: NFC leaves them alone and classes are undisputed.
_ODD = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: The letters and numbers among them.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The splitting pattern that a ByteLevel pre-tokenizer applies by default (a fixed value of the public format).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[int, str]:
    """The public byte-to-character rule: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _plain(pattern: str) -> re.Pattern:
    """The pattern for texts without odd characters: letter and number classes written out."""
    out, inside = "", False
    for token in re.findall(r"\\p\{[LN]\}|\\.|.", pattern):
        inside = {"[": True, "]": False}.get(token, inside)
        if token.startswith("\\p"):
            chars = _LETTERS if "L" in token else _NUMBERS
            token = chars if inside else f"[{chars}]"
        out += token
    return re.compile(out)


#: Bytes that a dictionary takes for an entry beside its key and value, at most.
ENTRY = 160


class WordEncoder:
    """Keeps the ids of words in at most ``cache_bytes``; once they are used up, it starts anew. Very long words aren't kept."""

    def __init__(self, path: str, cache_bytes: int = 48 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tok.get_vocab_size()
        self.lower, self.pattern = self._rules(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = _byte_chars()
        self.limit, self.held = cache_bytes, 0
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _rules(spec: dict):
        """(lower-cased?, splitting pattern), or (False, None) for a file of another shape."""
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm])] if norm else []
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            return False, None
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kinds:
            return False, _plain(_BYTE_LEVEL)
        parts = pre.get("pretokenizers", [])
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space"):
            return bool(kinds), _plain(parts[0]["pattern"]["Regex"])
        return False, None

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8").decode("latin-1").translate(self.table)
        ids = array("I", [t.id for t in self.tok.model.tokenize(raw)]).tobytes()
        cost = sys.getsizeof(word) + sys.getsizeof(ids) + ENTRY
        if self.held + cost > self.limit:
            self.words.clear()
            self.held = 0
        if cost <= self.limit // 64:
            self.words[word] = ids
            self.held += cost
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.pattern is None or not text.isascii() and _ODD.search(text) or _CONTROL.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        known = self.words
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            return b"".join([known.get(p) or self._word(p) for p in pieces])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker; the tokenizer is never shipped, each worker opens the file."""
    return WordEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["WordEncoder", "encoder", "tokenizer_path"]
