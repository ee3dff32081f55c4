"""SimHash near-duplicates by the generalised pigeonhole principle: one operator, ``near_duplicates``, with two notions of a link.

With ``distance``, 64-bit fingerprints link that differ in so few bits (below). With ``similarity``, texts link whose sets of
shingles have so large a Jaccard coefficient: wider fingerprints are probed by the same principle and candidates verified exactly (``similar``).

The bits of the fingerprints are grouped into partitions, correlated bits together. With m
partitions and thresholds T_i that add up to ``distance - m + 1`` (-1: the partition isn't looked at),
any two fingerprints within ``distance`` bits agree within T_i bits in at least one partition. The
number of partitions and the thresholds are chosen by dynamic programming over the probes and the
candidates that each partition is estimated to cost, from statistics over all fingerprints.

Each fingerprint is entered, for each partition, under its value there and the values up to T_i
bits away; fingerprints under one key are candidates, and pairs are verified in full. Only
different fingerprints take part, whatever the number of copies. A key with many fingerprints
isn't paired off: each of them is entered again with every centre half the distance away in the bits that vary
under that key. Two fingerprints within the distance share a centre, and all that share one
are within the distance of each other, so a chain through them loses no link and its length is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import similar
from textloom.llm.common import WORD, attach, bitmap_log2, bits_of, has_bit, lean, stage, table
from textloom.llm.components import components
from textloom.llm.pigeonhole import BITS, PROBE_COST, agreement, allocate, bit_counts, group_bits, masks

SEED = 42
#: Fingerprints under one key that are still paired off.
PAIRED = 24

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(WORD)


def fingerprint(text: str, width: int) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of the ``width``-word shingles, repeats included.

    Fewer words are one shingle; no words give 0.
    """
    words = _WORD.findall(text.translate(_UPPER))
    if not words:
        return 0
    if len(words) <= width:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(width))))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (doc_id, tag, text), the text replaced by its fingerprint (fp long)."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([signed(fingerprint(t.as_py(), width)) for t in b.column("text")], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "tag": b.column("tag"), "fp": fps})

    return lean(rows).mapInArrow(run, f"doc_id {kind}, tag long, fp long")


# ---- the plan ----


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the partitions that are looked at."""
    n, both = bit_counts(prints)
    found = []
    for m in range(1, distance + 3):
        groups, costs = group_bits(n, both, m), []
        for g in groups:
            share = agreement(n, both, g, distance)
            keys = [sum(comb(len(g), i) for i in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(PROBE_COST * keys[t] + n * share[t] * (1 if t == 0 else 2) for t in range(distance + 1))])
        found.append((*allocate(costs, distance - m + 1), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


# ---- probing and verifying ----


def _u(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def enter(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, own, fp): each fingerprint under its own value in each partition (own) and the values up to the threshold away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = _u(pdf["fp"])
            for k, (bits, t) in enumerate(parts):
                values = fps & np.uint64(sum(1 << b for b in bits))
                for m in masks(bits, t):
                    yield pd.DataFrame({"part": k, "key": (values ^ np.uint64(m)).view(np.int64), "own": m == 0, "fp": pdf["fp"]})

    return prints.select("fp").mapInPandas(run, "part int, key long, own boolean, fp long")


def links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` bits; ``prints``: different fingerprints (fp)."""
    parts = plan(prints, distance)
    entered = stage(enter(prints, parts), "simhash-keys")
    keys = entered.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners"), F.bit_and("fp").alias("common"), F.bit_or("fp").alias("some"))
    keys = stage(keys.filter("n > 1 and owners > 0"), "simhash-groups")
    rows = attach(entered, keys, ["part", "key"], "n", F.col("fp")).filter("n is not null")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for fps, own in zip(pdf["fps"], pdf["owns"]):
                x, own = np.asarray(fps, dtype=np.int64), np.asarray(own, dtype=bool)
                i, j = np.triu_indices(len(x), 1)
                near = (np.bitwise_count((x[i] ^ x[j]).view(np.uint64)) <= distance) & (own[i] | own[j])
                a.append(x[i[near]])
                b.append(x[j[near]])
            yield pd.DataFrame({"a": np.concatenate([*a, np.empty(0, np.int64)]), "b": np.concatenate([*b, np.empty(0, np.int64)])})

    small = rows.filter(F.col("n") <= paired).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("owns"))
    verified = small.select("fps", "owns").mapInPandas(pairs, "a long, b long")

    def centres(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_centre, out_fp = [], []
            for fp, vary in zip(_u(pdf["fp"]), _u(pdf["vary"])):
                bits = [b for b in range(BITS) if int(vary) >> b & 1]
                flips = np.array([f | 0 for f in masks(bits, distance // 2)], dtype=np.uint64)
                out_centre.append(fp ^ flips)
                out_fp.append(np.full(len(flips), fp))
            if out_fp:
                yield pd.DataFrame({"centre": np.concatenate(out_centre).view(np.int64), "fp": np.concatenate(out_fp).view(np.int64)})

    # bits that vary under any of a fingerprint's crowded keys; one set of centres per fingerprint
    crowded = rows.filter(F.col("n") > paired).groupBy("fp").agg(F.bit_or(F.expr("some & ~common")).alias("vary"))
    spread = crowded.mapInPandas(centres, "centre long, fp long")
    # those around a centre are different and at most distance // 2 bits away: a bounded number
    around = spread.groupBy("centre").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    chained = around.select(F.explode(F.transform(F.expr("slice(fps, 2, size(fps))"), lambda x: F.struct(F.col("fps")[0].alias("a"), x.alias("b")))).alias("e")).select("e.a", "e.b")
    return verified.union(chained).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """One row per input row: (doc_id, component_id, component_size), with ``fp`` if linked by ``distance``, with ``tag`` and ``kept`` if ``tag_col`` is given.

    Rows are linked whose fingerprints of ``width``-word shingles differ in at most ``distance`` (0 or 2) bits, or, if ``similarity`` is given, whose sets
    of shingles have at least that Jaccard coefficient. component_id is the smallest id reachable. Words are ``WORD`` runs after lower-casing
    A-Z; shorter texts are one shingle. Null and empty texts are alike and link like any other; texts are taken whole. Rows are told apart by
    their texts, so rows that share an id, or have none, are linked by what they say; a null id is a component's only if it has no other, and repeated
    rows each get a row. ``tag_col`` names a long that differs in all rows: ``kept`` is then true for one row of each component, that of the smallest id
    (ties: the smallest tag). Other columns are ignored, so their names can't clash; an empty input gives no rows.
    """
    if distance not in (0, 2):
        raise ValueError("distance must be 0 or 2: the centres of crowded keys are exact for even distances")
    tag = F.col(tag_col).cast("long") if tag_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), tag.alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("best")
    if similarity is None:
        key, prints = "fp", stage(fingerprints(rows, width), "simhash-prints")
        unique = stage(prints.groupBy("fp").agg(best, F.count("*").alias("n")).withColumn("node", F.col("fp")), "simhash-unique")
        edges = links(unique, distance) if distance else None
    else:
        words = similar.words_for(docs.count(), similarity)[0]
        key, prints = "digest", stage(similar.wide_prints(rows, width, words, similarity), "simhash-prints")
        unique = prints.groupBy("digest").agg(best, F.count("*").alias("n"), *[F.min_by(c, "mark").alias(c) for c in ("fp", "prefix")], F.min("mark").alias("mark"))
        unique = stage(unique.withColumn("node", F.monotonically_increasing_id()), "simhash-unique")
        edges = similar.links(rows, unique, similarity, width, words, similar.MOST)
    tagged = unique.select(key, "node", "best", "n")
    if edges is None:
        tagged = tagged.withColumn("label", F.col("node"))
    else:
        tagged = tagged.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    tagged = stage(tagged, "simhash-labels")
    comps = stage(tagged.groupBy("label").agg(F.min("best").alias("first"), F.sum("n").alias("component_size"), F.count("*").alias("m")), "simhash-comps")
    named = stage(attach(tagged, comps, ["label"], "m", F.col("node")).select(key, "n", "first", "component_size"), "simhash-named")
    out = attach(prints.select("doc_id", "tag", key), named, [key], "n", F.struct("doc_id", "tag"))
    more = [F.col("tag"), (F.col("tag") == F.col("first.tag")).alias("kept")] if tag_col else []
    return out.select("doc_id", *(["fp"] if similarity is None else []), F.col("first.doc_id").alias("component_id"), "component_size", *more)


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one of each component, all columns unchanged.

    Rows that stay aren't shuffled: a bitmap of those that go (64 MiB at most) tells most of them apart.
    """
    tagged = stage(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("tag")), "simhash-tagged")
    texts = tagged.select(F.col("whole")[id_col].alias("id"), F.col("whole")[text_col].alias("text"), "tag")
    found = near_duplicates(texts, width, similarity=similarity, id_col="id", tag_col="tag")
    lost = stage(found.filter("not kept").select(F.col("tag").alias("lost"), F.xxhash64("tag").alias("key")), "simhash-lost")
    log2 = bitmap_log2(lost.count())
    rows = has_bit(tagged.withColumn("key", F.xxhash64("tag")), stage(bits_of(lost, "key", log2), "simhash-lost-bits"), "key", "maybe", log2)
    sure = rows.filter("not maybe").select("whole")
    rest = rows.filter("maybe").join(lost.select("lost"), F.col("tag") == F.col("lost"), "left_anti").select("whole")
    return sure.unionByName(rest).select("whole.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
