"""Many words found in many texts in one pass: an Aho-Corasick automaton held as arrays.

The automaton is built level by level and sent to tasks as a few numpy arrays, about 20 bytes a character of the words. Texts are cut into
lanes that overlap by the longest word and walk side by side, one character a step, so no text is walked by a Python loop of its own and a long
text takes no longer than as many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of a lane without its overlap.
LANE = 512


class Automaton:
    """States are numbered by levels; state s > 0 is entered by the edge ``keys[s - 1]`` (state times classes plus class of the character)."""

    def __init__(self, words: list[str]):
        self.words = sorted({w for w in words if w})
        flat = np.frombuffer("".join(self.words).encode("utf-32-le"), dtype="<u4")
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        self.longest = int(lengths.max(initial=0))
        self.chars = np.unique(flat)
        self.classes = len(self.chars) + 1  # class 0: all other characters
        kinds = np.searchsorted(self.chars, flat) + 1
        at, levels, made = np.zeros(len(self.words), dtype=np.int64), [], 0
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(self.longest):
            on = np.flatnonzero(lengths > d)
            new, which = np.unique(at[on] * self.classes + kinds[starts[on] + d], return_inverse=True)
            at[on] = made + 1 + which
            made += len(new)
            levels.append(new)
            last = np.flatnonzero(lengths == d + 1)
            ends.append((at[last], last))
        self.keys = np.concatenate(levels) if levels else np.empty(0, dtype=np.int64)
        self.word = np.full(made + 1, -1, dtype=np.int32)
        for states, which in ends:
            self.word[states] = which
        self.root = np.zeros(self.classes, dtype=np.int64)
        if levels:
            self.root[levels[0]] = np.arange(len(levels[0])) + 1
        self.fall, self.link = np.zeros(made + 1, dtype=np.int64), np.zeros(made + 1, dtype=np.int64)
        done = 0
        for d, level in enumerate(levels):
            states = np.arange(done + 1, done + len(level) + 1)
            if d:
                self.fall[states] = self._next(self.fall[level // self.classes], level % self.classes)
            self.link[states] = np.where(self.word[states] >= 0, states, self.link[self.fall[states]])
            done += len(level)

    def _next(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states after one more character."""
        out = self.root[kind]
        deep = np.flatnonzero((state > 0) & (kind > 0))
        at, c = state[deep], kind[deep]
        while len(deep):
            key = at * self.classes + c
            i = np.searchsorted(self.keys, key)
            found = self.keys[np.minimum(i, len(self.keys) - 1)] == key
            out[deep[found]] = i[found] + 1
            at = self.fall[at[~found]]
            deep, c = deep[~found][at > 0], c[~found][at > 0]
            at = at[at > 0]
        return out

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """The class of each character."""
        if not len(self.chars):
            return np.zeros(len(codes), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[i] == codes, i + 1, 0)

    def walk(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(step, lanes, states): the lanes that have such a character, longest lane first, and their states after it."""
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        state = np.zeros(len(order), dtype=np.int64)
        for step in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            state[:n] = self._next(state[:n], kinds[starts[:n] + step])
            yield step, order[:n], state[:n]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) for each word that a text contains, once, by text and word; a null text contains none."""
        codes, offsets = characters(texts)
        if not self.words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        lanes = np.maximum(1, -(-np.diff(offsets) // LANE))
        text = np.repeat(np.arange(len(texts)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.maximum(offsets[text] + place * LANE - (self.longest - 1), offsets[text])
        ends = np.minimum(offsets[text] + (place + 1) * LANE, offsets[text + 1])
        found = [np.empty(0, dtype=np.int64)]
        for _, lane, state in self.walk(self.kinds(codes), starts, ends):
            link = self.link[state]
            hit = np.flatnonzero(link)
            if len(hit):
                found.append(text[lane[hit]] * len(self.link) + link[hit])
        pairs, out = np.unique(np.concatenate(found)), []
        while len(pairs):
            rows, state = pairs // len(self.link), pairs % len(self.link)
            out.append(rows * len(self.words) + self.word[state])
            below = self.link[self.fall[state]]
            pairs = np.unique(rows[below > 0] * len(self.link) + below[below > 0])
        both = np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)
        return both // len(self.words), both % len(self.words)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts end to end, and where each text begins and the last one ends."""
    plain = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])  # offsets from 0
    _, offsets, data = plain.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype="<u4"), np.zeros(len(plain) + 1, dtype=np.int64)
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4"), lead[offsets - offsets[0]]
