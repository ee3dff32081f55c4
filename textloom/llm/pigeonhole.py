"""The generalised pigeonhole principle: partitions of correlated bits, unequal thresholds, and what they cost.

Used by the near-duplicate operator (``simhash``) for both of its kinds of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
#: A probe (a row that is shuffled) costs as much as verifying so many candidates.
PROBE_COST = 40.0


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together), over all of them: 4097 numbers, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pd.DataFrame({"i": np.arange(BITS), "n": n, "row": list(both)})

    rows = prints.select("fp").mapInPandas(run, "i int, n double, row array<double>")
    flat = rows.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    both = np.zeros((BITS, BITS))
    for r in flat:
        both[r["i"], r["j"]] = r["x"]
    return (int(flat[0]["n"]) if flat else 0), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size; each grows from the free bit that is least balanced by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [min(free, key=lambda b: (-abs(p[b] - 0.5), b))]
        free.discard(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def agreement(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of the group, t = 0..most.

    A chain of bits, each dependent on the one before (from the pair counts), then a dynamic program over the number of differing bits.
    """
    p = np.clip(np.diag(both) / max(n, 1), 1e-6, 1 - 1e-6)
    dist, prev = np.array([1.0]), None
    for b in group:
        if prev is None:
            differ = 2 * p[b] * (1 - p[b])
        else:  # average over the value of the bit before
            j = both[prev, b] / max(n, 1)
            one, zero = np.clip(j / p[prev], 0, 1), np.clip((p[b] - j) / (1 - p[prev]), 0, 1)
            differ = p[prev] * 2 * one * (1 - one) + (1 - p[prev]) * 2 * zero * (1 - zero)
            differ = max(differ, 1e-4)
        dist = np.convolve(dist, [1 - differ, differ])
        prev = b
    return np.cumsum(dist)[: most + 1].tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``total`` at the least cost; costs[i][t + 1] is partition i's cost at threshold t, t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, cost in enumerate(row):
                x = (c + cost, [*ts, k - 1])
                if s + k - 1 not in nxt or x < nxt[s + k - 1]:
                    nxt[s + k - 1] = x
        best = nxt
    return best[total]


def masks(bits: list[int], most: int) -> list[int]:
    """All bit masks with at most ``most`` of ``bits``."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]
