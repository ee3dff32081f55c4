"""Words of many texts at once as 64-bit numbers, and hashes of any ranges of them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone, its bytes in parts of about this size.
SLICE = 1 << 20

U = np.uint64
P, Q = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
Q_INVERSE = U(pow(int(Q), -1, 1 << 64))
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A fixed random number per byte value.
BYTE = mix(np.arange(1, 257, dtype=U) * P)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse; tables for unusually long ranges aren't kept."""
    if n <= len(_POWERS.get("q", ())):
        return _POWERS["q"], _POWERS["r"]
    made = {}
    for name, base in (("q", Q), ("r", Q_INVERSE)):
        steps = np.full(max(SLICE + 2, n), base, dtype=U)
        steps[0] = 1
        made[name] = np.multiply.accumulate(steps)
    if not _POWERS:
        _POWERS.update({k: x[: SLICE + 2] for k, x in made.items()})
    return made["q"], made["r"]


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit numbers, from prefix sums."""

    def __init__(self, values: np.ndarray):
        q, self.inverse = _powers(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(values * q[: len(values)], dtype=U)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U) * P)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts with up to ``SLICE`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one more) of the words of texts held end to end."""
    n = len(data)
    space = SPACE[data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, from its bytes alone; works through about ``SLICE`` bytes at a time."""
    if len(data) <= 2 * SLICE:
        return Ranges(BYTE[data]).hash(starts, ends)
    out, i = np.empty(len(starts), dtype=U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        out[i:j] = Ranges(BYTE[data[starts[i] : ends[j - 1]]]).hash(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out
