"""The best way to cut stretches of Han characters into words: a dynamic program over a lattice of dictionary words.

The words come from one or several automata. All stretches of a batch are worked on side by side, one character a step; the path is
the one with the greatest sum of scores (whole numbers), and the longer last word among equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.functions.automaton import Automaton, characters

HAN = (0x4E00, 0x9FFF)
#: Bytes of texts that are worked on at a time: what a task holds beside them is some tens of times as much, however long its batches are.
PIECE = 1 << 20
LOWEST = np.iinfo(np.int64).min // 4


def stretches(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of Han characters begin and end; none goes across texts."""
    han = (codes >= HAN[0]) & (codes <= HAN[1])
    first, last = han.copy(), han.copy()
    first[1:] &= ~han[:-1]
    last[:-1] &= ~han[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(codes))]
    first[edge] = han[edge]
    last[edge - 1] = han[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_sizes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, automata: list[tuple[Automaton, np.ndarray]], unknown: int) -> np.ndarray:
    """For each character the length of the word that ends there on the best path to it; ``automata``: with the scores of their words."""
    size = np.ones(len(codes), dtype=np.int32)
    best = np.full(len(codes) + len(starts), LOWEST, dtype=np.int64)
    base = starts + np.arange(len(starts))  # a stretch of n characters has n + 1 places
    best[base] = 0
    lengths = [np.array([len(w) for w in a.words], dtype=np.int64) for a, _ in automata]
    walks = [a.walk(a.kinds(codes), starts, ends) for a, _ in automata]
    for parts in zip(*walks):
        step, lanes = parts[0][0], parts[0][1]
        here, top, long = base[lanes] + step + 1, np.full(len(lanes), LOWEST), np.ones(len(lanes), dtype=np.int64)
        for (automaton, scores), length, (_, _, state) in zip(automata, lengths, parts):
            link, on = automaton.link[state], np.arange(len(lanes))
            while True:
                on, link = on[link > 0], link[link > 0]
                if not len(on):
                    break
                word = automaton.word[link]
                score = best[here[on] - length[word]] + scores[word]
                better = (score > top[on]) | ((score == top[on]) & (length[word] > long[on]))
                top[on[better]], long[on[better]] = score[better], length[word][better]
                link = automaton.link[automaton.fall[link]]
        alone = best[here - 1] + unknown
        top, long = np.where(alone > top, alone, top), np.where(alone > top, 1, long)
        best[here], size[starts[lanes] + step] = top, long
    return size


def pieces(texts: pa.Array, size: int = PIECE) -> list[pa.Array]:
    """The texts in pieces of about ``size`` bytes; a longer text is a piece of its own, and no text is divided."""
    sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, at = [0], 0
    while at < len(texts):
        before = int(sums[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(sums, before + size, side="right")))
        cuts.append(at)
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def cut_words(texts: pa.Array, automata: list[tuple[Automaton, np.ndarray]], unknown: int) -> pa.ListArray:
    """The words of the best paths of each text, in order; other characters than Han are left out. Equal stretches are cut once."""
    codes, offsets = characters(texts)
    starts, ends = stretches(codes, offsets)
    borders = np.concatenate(([0], np.cumsum(ends - starts)))
    han = codes[(codes >= HAN[0]) & (codes <= HAN[1])].astype("<u2")  # stretch by stretch
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * borders).astype(np.int32)), pa.py_buffer(han)]).dictionary_encode()
    which, own = runs.indices.to_numpy(zero_copy_only=False), runs.dictionary
    borders = np.concatenate(([0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False)))).astype(np.int64) // 2
    codes = np.frombuffer(b"".join(own.to_pylist()), dtype="<u2")
    size = word_sizes(codes, borders[:-1], borders[1:], automata, unknown)
    begins = np.zeros(len(codes) + 1, dtype=bool)
    at, lane = borders[1:].copy(), borders[:-1].copy()
    while len(at):  # all paths are followed back side by side
        at = at - size[at - 1]
        begins[at] = True
        at, lane = at[at > lane], lane[at > lane]
    first = np.flatnonzero(begins)  # a word ends where the next one begins
    raw = codes.tobytes().decode("utf-16-le").encode()  # three bytes a character
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer((3 * np.append(first, len(codes))).astype(np.int32)), pa.py_buffer(raw)])
    place = np.searchsorted(first, borders)
    number = np.diff(place)[which]
    sums = np.concatenate(([0], np.cumsum(number)))
    rows = np.repeat(place[which] - sums[:-1], number) + np.arange(sums[-1])
    return pa.ListArray.from_arrays(pa.array(sums[np.searchsorted(starts, offsets)], pa.int32()), words.take(pa.array(rows)))
