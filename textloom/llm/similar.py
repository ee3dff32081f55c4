"""Links of a given similarity for the near-duplicate operator (``simhash.near_duplicates``), by wide SimHash fingerprints.

A 64-bit fingerprint tells texts of 0.8 similarity apart from 0.6 only roughly, so several 64-bit words are made.
Every word is looked up by the principle of ``pigeonhole``: its correlated bits are grouped, and
candidates are those that agree in a partition of any word, within its threshold. Partitions and thresholds are allocated by dynamic
programming: the least cost under which a pair of the wanted similarity is found with a chance of ``RECALL`` at least.
The constraint holds for every number of fingerprints; what grows with it is the cost, and the number of words (``words_for``).
A row that is entered under a key carries ``CARRIED`` words only, which is enough to sort out texts that have nothing in common.

Majorities of few shingles differ by more than the formula says, so sets of up to ``SHORT`` shingles are looked up by shingles
instead: of any two sets of the wanted similarity, the smallest few hashes of each have one in common (prefix filter), so none of these is missed.

Bits and the sizes of the shingle sets only sort out candidates, with a bound that nearly every pair of the
similarity keeps. What remains is verified: the shingle sets of the candidates are fetched, and two texts are
linked if the Jaccard coefficient of their sets is at least ``similarity``. Texts with equal sets are one node.

Candidates under a key are compared inside one task, which returns groups of nodes, never their
pairs. For a key with more than ``MOST`` fingerprints, all are first compared with one of them, the hub, and verified: what is linked to the hub needn't be compared with
each other any more, so a large family of near copies costs a row per copy. The rest is dealt out as blocks that meet each other and
the blocks of the family in tasks of bounded size, and so is a group with more than ``ROOM`` shingles; no link is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, bitmap_log2, bits_of, has_bit, lean, stage
from textloom.llm.components import components
from textloom.llm.pigeonhole import PROBE_COST, agreement, group_bits, masks
from textloom.llm.words import P, Q, Ranges, bounds, mix, slices, word_hashes
from textloom.operators.skew import join_back

#: Least chance that a pair of exactly the wanted similarity is verified, whatever the size of the corpus.
RECALL = 0.99
#: Thresholds of a partition.
SLACK = 3
#: A word of a fingerprint costs as much as verifying so many candidates.
WORD_COST = 80.0
#: Words of a fingerprint that travel with a key.
CARRIED = 4
#: Sets of up to so many shingles are looked up by their smallest hashes.
SHORT = 32
#: Fingerprints that are compared in one task.
MOST = 3000
#: Nodes that are verified with a hub in one list.
CHUNK = 128
#: Lists of one node that a task may get, each with the node's set.
SHARE = 1000
#: Shingles of a group that is verified in one task.
ROOM = 1 << 21
#: Fingerprints under a key up to which pairs are compared in bulk.
BULK = 256

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32


def share_of_bits(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of the shingle sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_of(similarity: float, words: int) -> int:
    """Differing bits up to which a pair is verified: the expectation and three standard deviations."""
    p, n = share_of_bits(similarity), 64 * words
    return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


def short_limit(similarity: float, words: int) -> int:
    """The same for short sets: majorities of four to 32 shingles differ in up to 0.1875 of the bits at 0.8, 1.24 times the share; six standard deviations."""
    p, n = 1.24 * share_of_bits(similarity), 64 * words
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def within(n: int, p: float, most: int) -> float:
    """Chance that at most ``most`` of ``n`` bits differ."""
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    return min(1.0, sum(math.exp(log(k)) for k in range(most + 1)))


def recall(similarity: float, parts: list[list[tuple[list[int], int]]]) -> float:
    """Chance that a pair agrees within the threshold in at least one partition of the plan."""
    q = share_of_bits(similarity)
    return 1 - math.prod(1 - within(len(bits), q, t) for plan in parts for bits, t in plan)


def wanted(similarity: float) -> float:
    """The recall that a plan must have so that, after the limit of the carried bits, ``RECALL`` is left."""
    return RECALL / within(64 * CARRIED, share_of_bits(similarity), limit_of(similarity, CARRIED))


def words_for(n: int, similarity: float) -> tuple[int, int]:
    """(words, partitions of each) whose plan costs least for ``n`` fingerprints of even bits, 8 words at least; longer keys need more words."""
    q, best = share_of_bits(similarity), (math.inf, 8, 4)
    for per_word in range(1, 9):
        parts = math.ceil(math.log(1 - wanted(similarity)) / math.log(1 - within(math.ceil(64 / per_word), q, 0)))
        words = max(8, math.ceil(1.02 * parts / per_word))
        best = min(best, (parts * (PROBE_COST + n * 0.5 ** (64 // per_word)) + words * WORD_COST, words, per_word))
    return best[1:]


def prefixes(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest hashes of a sorted set, one of which any different set of the similarity shares, where either has up to ``SHORT``; else none."""
    n = len(hashes)
    if n * similarity > SHORT + 1e-9 or n < similarity * (n + 1) - 1e-9:
        return hashes[:0]
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the ``width``-word shingles of each text, first one per text); A-Z are lower-cased. Fewer words are one shingle."""
    data = _UPPER[data]
    starts, ends, word_at = bounds(data, offsets)
    count = np.diff(word_at)
    words = word_hashes(data, starts, ends)
    ranges = Ranges(words)
    n_shingles = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.repeat(word_at[:-1] - first[:-1], n_shingles) + np.arange(first[-1])
    return ranges.hash(at, at + np.repeat(np.minimum(count, width), n_shingles)), first


def wide_print(hashes: np.ndarray, words: int) -> bytes:
    """Bit i is 1 if it is set in over half of the shingles' hashes; zero without shingles."""
    total = np.zeros(64 * words, dtype=np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * P
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(mix(hashes[at : at + 255, None] + salt).view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    return np.array([mix(hashes + P).sum(dtype=np.uint64), mix(hashes ^ Q).sum(dtype=np.uint64)], dtype="<u8").tobytes()


def _sets(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, sorted sets of shingles) of the texts of a batch, slice by slice."""
    for at, to, data, offsets in slices(b.column("text")):
        h, first = shingles(data, offsets, width)
        yield at, to, [np.unique(h[first[i] : first[i + 1]]) for i in range(to - at)]


def wide_prints(rows: DataFrame, width: int, words: int, similarity: float) -> DataFrame:
    """(doc_id, tag, mark, digest, fp, prefix) for every row of ``rows`` (doc_id, tag, text).

    mark: a hash of the text; digest: of its set of shingles; fp: the fingerprint and, as one more word, the number of different shingles.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, sets in _sets(b, width):
                prints = [wide_print(x, words) + len(x).to_bytes(8, "little") for x in sets]
                prefix = pa.array([prefixes(x, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
                own = b.slice(at, to - at)
                yield pa.RecordBatch.from_pydict({**{c: own.column(c) for c in ("doc_id", "tag", "mark")}, "digest": pa.array(map(digest, sets), pa.binary()), "fp": pa.array(prints, pa.binary()), "prefix": prefix})

    marked = rows.select("doc_id", "tag", F.xxhash64("text").alias("mark"), "text")
    return lean(marked).mapInArrow(run, f"doc_id {kind}, tag long, mark long, digest binary, fp binary, prefix array<long>")


def _matrix(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, sizes of the sets)."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, words + 1)
    return x[:, :words], x[:, words].astype(np.int64)


def cheapest(options: list[list[tuple[float, float]]], least: float, steps: int = 4000) -> tuple[float, list[int]]:
    """Thresholds, -1 for a partition that isn't looked at, of the least cost whose gains add up to ``least``; options: (cost, gain) per partition and threshold.

    Gains count in ``steps``, rounded down, so that the sum is never below ``least``. Infinite cost if all together don't reach it.
    """
    best, chosen = np.full(steps + 1, np.inf), []
    best[0] = 0
    for row in options:
        new, pick, source = best.copy(), np.full(steps + 1, -1), np.arange(steps + 1)
        for t, (cost, gain) in enumerate(row):
            by = min(steps, int(gain / least * steps))
            value, at = np.full(steps + 1, np.inf), np.arange(steps + 1) - by
            value[by:] = best[: steps + 1 - by] + cost
            at[steps] = steps - by + np.argmin(best[steps - by :])  # all that reach the last step
            value[steps] = best[at[steps]] + cost
            better = value < new
            new[better], pick[better], source[better] = value[better], t, at[better]
        best = new
        chosen.append((pick, source))
    ts, at = [], steps
    for pick, source in reversed(chosen):
        ts.append(int(pick[at]))
        at = source[at]
    return float(best[steps]), ts[::-1]


def plan(n: int, both: np.ndarray, words: int, similarity: float, slack: int = SLACK) -> list[list[tuple[list[int], int]]]:
    """For each word, the partitions that are looked at and their thresholds: least cost at the wanted recall. ``both``: counts of bits set together."""
    q, least, found = share_of_bits(similarity), -math.log(1 - wanted(similarity)), []
    per_word = words_for(n, similarity)[1]
    for m in range(max(1, per_word - 1), per_word + 2):
        groups = [g for k in range(words) for g in group_bits(n, both[64 * k : 64 * k + 64], m)]
        options = []
        for i, g in enumerate(groups):
            share = agreement(n, both[64 * (i // m) : 64 * (i // m) + 64], g, slack)
            keys = [sum(math.comb(len(g), i) for i in range(t + 1)) for t in range(slack + 1)]
            options.append([(PROBE_COST * keys[t] + n * share[t] * (1 if t == 0 else 2), -math.log1p(-min(within(len(g), q, t), 1 - 1e-12))) for t in range(slack + 1)])
        cost, ts = cheapest(options, least)
        found.append((cost, [[(g, t) for g, t in zip(groups[m * k : m * k + m], ts[m * k : m * k + m]) if t >= 0] for k in range(words)]))
    cost, best = min(found, key=lambda x: x[0])
    if math.isinf(cost):
        raise ValueError(f"{words} words are too few for a recall of {RECALL}")
    return best


def plans(prints: DataFrame, words: int, similarity: float) -> list[list[tuple[list[int], int]]]:
    """The plan, from the bit statistics of all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((words, 64, 64))
        for b in batches:
            x, _ = _matrix(b.column("fp"), words)
            for k in range(words):
                bits = np.unpackbits(np.ascontiguousarray(x[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[k] += bits.T @ bits
            n += len(x)
        rows = both.reshape(words * 64, 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words * 64, dtype=np.int32)), pa.array(np.full(words * 64, float(n))), pa.array(list(rows))], names=["i", "n", "row"])

    flat = prints.select("fp").mapInArrow(run, "i int, n double, row array<double>")
    sums = flat.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    both = np.zeros((words * 64, 64))
    for r in sums:
        both[r["i"], r["j"]] = r["x"]
    n = int(sums[0]["n"]) if sums else 0
    return plan(n, both, words, similarity)


def star(nodes: np.ndarray, x: np.ndarray, limit: int, side: np.ndarray | None = None, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node, other) of each group of linked fingerprints. ``side``: only pairs from different sides are compared, if given.

    ``alike`` tells for a position and an array of positions which of these are linked to it, beyond the bits.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, x = nodes[order], x[order]
    side = None if side is None else side[order]
    free = np.ones(len(nodes), dtype=bool)
    a, b = [], []
    for i in range(len(nodes)):
        if not free[i]:
            continue
        free[i] = False
        edge = [i]
        while edge:
            j = edge.pop()
            rest = np.flatnonzero(free)
            near = rest[np.bitwise_count(x[rest] ^ x[j]).sum(axis=1) <= limit]
            if side is not None:
                near = near[side[near] != side[j]]
            if alike is not None and len(near):
                near = near[alike(order[j], order[near])]
            free[near] = False
            edge += near.tolist()
            a.append(np.full(len(near), nodes[i]))
            b.append(nodes[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def fits(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


def allowed(a: np.ndarray, b: np.ndarray, limit: int, loose: int) -> np.ndarray:
    """Differing bits allowed: ``limit``, or ``loose`` where a set is short."""
    return np.where(np.minimum(a, b) > SHORT, limit, loose)


def paired(start: np.ndarray, end: np.ndarray, x: np.ndarray, sizes: np.ndarray, limit: int, loose: int, similarity: float) -> np.ndarray:
    """Which groups of rows (from ``start`` to ``end``) hold a pair of candidates; all groups at once, one distance between rows after the other."""
    found = np.zeros(len(start), dtype=bool)
    group = np.repeat(np.arange(len(start)), end - start)
    i = np.concatenate([np.arange(a, b) for a, b in zip(start, end)]) if len(start) else np.empty(0, np.int64)
    for d in range(1, int((end - start).max(initial=1))):
        some = (i + d < end[group]) & ~found[group]
        i, group = i[some], group[some]
        near = np.flatnonzero(fits(sizes[i], sizes[i + d], similarity))
        near = near[np.bitwise_count(x[i[near]] ^ x[i[near] + d]).sum(axis=1) <= allowed(sizes[i[near]], sizes[i[near] + d], limit, loose)]
        found[group[near]] = True
    return found


def deal(nodes: np.ndarray, sizes: np.ndarray, room: int) -> list[np.ndarray]:
    """The nodes, or, if they have more than ``room`` shingles, every two of their blocks of half of it."""
    if sizes.sum() <= room:
        return [nodes]
    block = (np.cumsum(sizes) - sizes) // max(room // 2, 1)
    blocks = [nodes[block == k] for k in np.unique(block)]
    return [np.concatenate(two) for two in combinations(blocks, 2)] or blocks


def short(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The part of the fingerprints that travels: ``CARRIED`` words and the size."""
    rows = np.ascontiguousarray(np.concatenate((x[:, :CARRIED], sizes.astype("<u8")[:, None]), axis=1))
    ends = np.arange(0, rows.nbytes + 1, 8 * (CARRIED + 1), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def entries(prints: DataFrame, parts: list[tuple[int, list[int], int]], words: int) -> DataFrame:
    """(key, node, fp): each fingerprint under all its keys; ``parts``: (first bit of the word, bits, threshold)."""
    salts = np.arange(1, len(parts) + 1, dtype=np.uint64) * P

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, sizes = _matrix(b.column("fp"), words)
            carried, nodes = short(x, sizes), b.column("node")
            lists = b.column("prefix")
            smallest, at = lists.flatten().to_numpy().view(np.uint64), pa.array(np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array(mix(smallest).view(np.int64)), nodes.take(at), carried.take(at)], names=["key", "node", "fp"])
            long = pa.array(sizes > SHORT)
            x, carried, nodes = x[sizes > SHORT], carried.filter(long), nodes.filter(long)
            for p, (base, bits, t) in enumerate(parts):
                values = x[:, base // 64] & np.uint64(sum(1 << v for v in bits))
                for m in masks(bits, t):
                    key = mix((values ^ np.uint64(m)) + salts[p])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), nodes, carried], names=["key", "node", "fp"])

    return lean(prints.select("node", "fp", "prefix")).mapInArrow(enter, "key long, node long, fp binary")


def hub_lists(crowd: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """(list, node): each member of a crowded key that may be linked to the key's hub, in lists of ``CHUNK`` with the hub."""
    limit, loose = limit_of(similarity, CARRIED), short_limit(similarity, CARRIED)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, size), (y, hub_size) = _matrix(b.column("fp"), CARRIED), _matrix(b.column("hub_fp"), CARRIED)
            some = fits(size, hub_size, similarity) & (np.bitwise_count(x ^ y).sum(axis=1) <= allowed(size, hub_size, limit, loose))
            yield pa.RecordBatch.from_pydict({c: b.column(c).filter(pa.array(some)) for c in ("hub", "node", "n")})

    rows = attach(crowd, hubs, ["key"], "n", F.col("node")).filter("node <> hub").select("hub", "hub_fp", "node", "fp", "n")
    pairs = lean(rows).mapInArrow(near, "hub long, node long, n long").groupBy("hub", "node").agg(F.max("n").alias("n"))
    listed = pairs.select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK))).alias("list"), "hub", "node")
    return listed.select("list", F.explode(F.array("hub", "node")).alias("node")).distinct()


def links(rows: DataFrame, unique: DataFrame, similarity: float, width: int, words: int, most: int) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links; ``unique``: a staged row (node, fp, prefix, mark, digest) per set of shingles, ``rows``: (text)."""
    parts = [(64 * k, bits, t) for k, plan in enumerate(plans(unique, words, similarity)) for bits, t in plan]
    entered = entries(unique, parts, words)
    large = stage(entered.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "similar-large")
    if large.isEmpty():
        dealt = entered.select("key", "node", "fp", F.lit(0).alias("mine"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        return verified(rows, unique, stage(candidates(dealt, similarity), "similar-lists"), similarity, width)
    sized = stage(attach(entered, large, ["key"], "n", F.col("node")), "similar-entered")
    crowd = sized.filter("n is not null").drop("n")
    hub = F.min_by(F.struct("node", "fp"), F.xxhash64("node"))
    hubs = stage(crowd.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("n")).select("key", F.col("hub.node").alias("hub"), F.col("hub.fp").alias("hub_fp"), "n"), "similar-hubs")
    first = stage(verified(rows, unique, stage(hub_lists(crowd, hubs, similarity), "similar-hub-lists"), similarity, width), "similar-hub-links")
    family = components(first).select(F.col("node").alias("__node"), "label")
    named = hubs.join(family, F.col("hub") == F.col("__node"), "left").select("key", F.coalesce("label", "hub").alias("hub_label"), "n")
    crowd = attach(crowd, stage(named, "similar-hub-labels"), ["key"], "n", F.col("node")).join(family, F.col("node") == F.col("__node"), "left")
    crowd = stage(crowd.select("key", "node", "fp", (F.coalesce("label", "node") == F.col("hub_label")).alias("kin")), "similar-crowd")
    shape = crowd.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count_if(~F.col("kin")) / (most // 2)).cast("int").alias("others"), F.ceil(F.count_if(F.col("kin")) / (most // 2)).cast("int").alias("kins"))
    crowd = attach(crowd, stage(shape, "similar-shape"), ["key"], "n", F.col("node")).filter("others > 0")
    # blocks of others first, then those of kin; a pair of blocks meets if one of them is of others
    mine = F.when(F.col("kin"), F.col("others") + F.pmod(F.xxhash64("node"), "kins")).otherwise(F.pmod(F.xxhash64("node"), F.greatest("others", F.lit(1)))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("kin"), F.col("others")).otherwise(F.col("others") + F.col("kins")) - 1)
    crowd = crowd.select("key", "node", "fp", mine.alias("mine"), F.explode(meets).alias("other"))
    crowd = crowd.select("key", "node", "fp", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    plain = sized.filter("n is null").select("key", "node", "fp", F.lit(0).alias("mine"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    lists = stage(candidates(plain.unionByName(crowd), similarity), "similar-lists")
    return first.unionByName(verified(rows, unique, lists, similarity, width)).distinct()


def candidates(dealt: DataFrame, similarity: float) -> DataFrame:
    """(list, node): every pair of candidates is in some list; ``dealt``: (key, node, fp, mine, lo, hi), rows of a key in the blocks lo and hi meet."""
    limit, loose = limit_of(similarity, CARRIED), short_limit(similarity, CARRIED)
    groups = dealt.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("node", "fp", "mine")).alias("rows")).filter(F.size("rows") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            nodes, mine_ = flat.field("node").to_numpy(), flat.field("mine").to_numpy()
            x, sizes = _matrix(flat.field("fp"), CARRIED)
            two = np.asarray(batch.column("lo")) != np.asarray(batch.column("hi"))
            bulk = np.flatnonzero(np.diff(at) <= BULK)
            left = np.ones(len(two), dtype=bool)
            left[bulk] = paired(at[bulk], at[bulk + 1], x, sizes, limit, loose, similarity)
            names, members = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for k in np.flatnonzero(left):
                some = slice(at[k], at[k + 1])
                size, fps = sizes[some], x[some]

                def alike(i: int, j: np.ndarray, size=size, fps=fps) -> np.ndarray:
                    return fits(size[i], size[j], similarity) & (np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1) <= allowed(size[i], size[j], limit, loose))

                a, b = star(nodes[some], fps, limit if size.min() > SHORT else loose, mine_[some] if two[k] else None, alike)
                for root in np.unique(a):
                    group = np.sort(np.append(b[a == root], root))
                    for one in deal(group, size[np.argsort(nodes[some])][np.searchsorted(np.sort(nodes[some]), group)], ROOM):
                        names.append(np.full(len(one), mix(mix(one.view(np.uint64)) + P * np.arange(1, len(one) + 1, dtype=np.uint64)).sum(dtype=np.uint64)))
                        members.append(one)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(members))], names=["list", "node"])

    return lean(groups).select("lo", "hi", "rows").mapInArrow(link, "list long, node long").distinct()


def jaccard_star(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node, other) of each group linked by Jaccard coefficients of at least ``similarity``."""
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    shared, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(shared), dtype=bool)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        out = fits(sizes[i], sizes[others], similarity)
        some = others[out]
        if len(some):
            mark[flat[first[i] : first[i] + sizes[i]]] = True
            if 16 * len(some) > len(sizes):
                common = np.add.reduceat(mark[flat], first, dtype=np.int64)[some]
            else:
                common = np.array([np.count_nonzero(mark[flat[first[j] : first[j] + sizes[j]]]) for j in some])
            mark[flat[first[i] : first[i] + sizes[i]]] = False
            out[out] = common >= similarity * (sizes[i] + sizes[some] - common) - 1e-9
        return out

    return star(nodes, np.zeros((len(nodes), 1), np.uint64), 0, alike=alike)


def verified(rows: DataFrame, unique: DataFrame, lists: DataFrame, similarity: float, width: int) -> DataFrame:
    """Edges (a, b) between nodes of a list that are linked; ``lists``: a staged table (list, node).

    A bitmap of the listed texts' hashes sorts out all others where they are; of each set of shingles one copy travels.
    """
    wanted_ = stage(unique.join(lists.select("node").distinct(), "node", "left_semi").select("node", "digest", "mark"), "similar-wanted")
    log2 = bitmap_log2(wanted_.count())
    marked = rows.select("text", F.xxhash64("text").alias("mark"))
    some = has_bit(marked, stage(bits_of(wanted_, "mark", log2), "similar-bits"), "mark", "__wanted", log2).filter("__wanted").select("text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets in _sets(b, width):
                yield pa.RecordBatch.from_pydict({"digest": pa.array(map(digest, sets), pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    taken = lean(some).mapInArrow(take, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    taken = taken.join(wanted_.select("digest", "node"), "digest").select("node", "shingles")
    # a hub is in a list for every ``CHUNK`` of its members: its set is entered once for each ``SHARE`` of them
    listed = join_back(lists, taken, "node", spread=F.col("list"), share=SHARE).filter("shingles is not null")
    groups = listed.groupBy("list").agg(F.collect_list(F.struct("node", "shingles")).alias("rows"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("rows"):
                nodes = row.values.field("node").to_numpy()
                a, b = jaccard_star(nodes, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in row.values.field("shingles")], similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lean(groups.select("rows")).mapInArrow(verify, "a long, b long").distinct()
