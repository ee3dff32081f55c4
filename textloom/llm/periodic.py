"""Periodic runs of words, found by Lyndon arrays (after Ellert and Fischer): no suffix structures and no hashed comparisons.

A run is a maximal stretch with smallest period q. Every run of two periods or more holds a Lyndon word of length q, under an order
of the letters or under its reverse, that is the longest one at its place. So the edges (i, j), where j is the
next position whose suffix is smaller than that at i, name the periods j - i of all runs, and the matches of the suffixes at i and
j say how far a run reaches.

``lyndon_edges`` finds edges and matches in one pass from left to right with a stack. Letters are compared one by one, but no
letter twice behind the rightmost position reached so far: within the last matched extension, the outcome is copied from its first occurrence,
and along the stack from the neighbours' matches. So each order takes linear time for any text.

Words are numbered by first occurrence; any total order serves. A run of three periods or more holds each of its words three times
at least, so words that a text has once or twice cut it into parts that are worked on by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, lean, table

#: A run counts if it has so many words, and so many times its period.
LEAST, TIMES = 24, 3

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int]]:
    """(next, match): for each position the next one whose suffix is smaller (or the length), and how many letters both suffixes share.

    Letters are numbers of zero or more. A suffix that is a prefix of another one is smaller.
    """
    n = len(x)
    x = [*x, -1]  # ends all matches
    after, match = [n] * n, [0] * n  # the next smaller suffix
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix: what is below on the stack
    reach = shift = since = 0  # x[since:reach] == x[since - shift:reach - shift]
    for j in range(1, n):
        t, c = j - 1, x[j]
        if j < reach:
            known = match[t - shift] if after[t - shift] == j - shift else shared[j - shift]
            fresh = known >= reach - j
            length = reach - j if fresh else known
        else:
            fresh, length = True, 0
        while True:
            if fresh:
                if x[t + length] == x[j + length]:
                    length += 1
                    while x[t + length] == x[j + length]:
                        length += 1
                if j + length > reach:
                    reach, shift, since = j + length, j - t, j
            if x[t + length] < (x[j + length] if length else c):
                before[j], shared[j] = t, length
                break
            after[t], match[t] = j, length
            below = before[t]
            if below < 0:
                break
            common = shared[t]
            t = below
            if length > common:
                before[j], shared[j] = t, common
                break
            fresh = False
            if length == common:
                if j + length < reach and t >= since:
                    known = match[t - shift] if after[t - shift] == j - shift else shared[j - shift]
                    fresh = known >= reach - j
                    length = reach - j if fresh else known
                else:
                    fresh = True
    return after, match


def _runs_of(x: list[int], least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the runs of one sequence of numbers."""
    out, top = set(), max(x)
    for letters in (x, [top - c for c in x]):
        after, match = (np.array(a, dtype=np.int64) for a in lyndon_edges(letters))
        period = after - np.arange(len(x))
        # the first Lyndon word of a run begins within its first period, so that what follows it is longer than times - 2 periods
        some = np.flatnonzero((match > (times - 2) * period) & (match + 2 * period > least))
        ends: set[tuple[int, int]] = set()
        for i, p, r in zip(some.tolist(), period[some].tolist(), match[some].tolist()):
            end = i + p + r
            if (p, end) in ends:  # a later Lyndon word of the same run
                continue
            ends.add((p, end))
            start = i
            while start and x[start - 1] == x[start - 1 + p]:
                start -= 1
            if end - start >= max(least, times * p):
                out.add((start, end, p))
    return out


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words and ``times`` (3 or more) periods, by start and period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't told apart from their parts here")
    if len(words) < least:
        return []
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array(list(map(numbers.__getitem__, words)), dtype=np.int64)
    cuts = np.flatnonzero(np.bincount(x)[x] < times)
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(x)]))
    out = []
    for a, b in zip(starts[ends - starts >= least].tolist(), ends[ends - starts >= least].tolist()):
        part = x[a:b].tolist()
        out += [(a + s, e - s, p) for s, e, p in _runs_of(part, least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that some run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per input row: (doc_id, n_words, runs, text): the runs by start and period, and the text with every run cut to one period.

    Words are maximal stretches without ASCII white space. A null or empty text has no words, no runs and an empty text. Rows are
    worked on one by one, so repeated rows and ids, and null ids, stay as they are; other columns of the input are
    ignored, so that their names can't clash. An empty input gives no rows. Nothing is shuffled; a long text is worked on alone in linear time.
    """
    text = text_col if isinstance(text_col, Column) else docs[text_col]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, offsets, flat, texts = [], [0], [], []
            for value in batch.column("text"):
                words = value.as_py().split()  # of bytes: at ASCII white space
                runs = find_runs(words, least, times)
                counts.append(len(words))
                flat += runs
                offsets.append(len(flat))
                texts.append(collapse(words, runs))
            each = np.array(flat, dtype=np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(each[:, k]) for k in range(3)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, type=kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

    return lean(rows).mapInArrow(run, FOUND)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: in a tenth of the documents, by the checksum of the id, the words from some place on repeat with some period.

    Null ids and texts without words stay as they are; in the others the words are joined by one space.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("int")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, F.when(i < a, i).otherwise(a + (i - a) % p) + 1)), " ")

    # an array of one array binds the words once, so that the pattern isn't run for every word
    bound = F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeat)
    return F.when(h % 10 == 0, F.coalesce(F.try_element_at(bound, F.lit(1)), text)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, text_col=planted(docs["doc_id"], docs["text"]))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # length / period without rounding; of equals, the first by start and period stays
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    listed = F.array_join(lines, "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("__best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"__best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"),
        sha(F.col("text")).alias("collapsed_sha256"),
    )
