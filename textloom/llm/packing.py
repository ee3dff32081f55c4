"""Packing by bounded-space online best fit.

Each partition of the input keeps at most ``windows`` open windows. A piece goes into the window
it fits best; when it fits none and all windows are in use, the fullest is emitted. Before that, a gap of
``min_cut`` tokens or more is closed with the head of the piece, since documents may be cut
anywhere. What stays open at the end of each partition is merged in rounds of ``fan`` partitions
at a time, whole pieces only, until one set of open windows is left. Only piece descriptors are
kept between the rounds; each text is tokenized once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lean, stage, table
from textloom.llm.tokens import encoder, tokenizer_path

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, used long, open boolean"


class Packer:
    """At most ``windows`` open windows of ``size`` tokens; gaps are kept sorted."""

    def __init__(self, size: int, windows: int, min_cut: int):
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.next = 0
        self.closed: list[int] = []

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """Cut ``length`` tokens into pieces: (piece length, window, offset in it)."""
        out = []
        while length >= self.size:
            out.append((self.size, self._new(), 0))
            self.closed.append(out[-1][1])
            length -= self.size
        while length:
            i = bisect_left(self.gaps, (length, -1))
            if i < len(self.gaps):
                gap, w = self.gaps.pop(i)
                out.append((length, w, self.size - gap))
                self._back(gap - length, w)
                return out
            if len(self.gaps) < self.windows:
                w = self._new()
                out.append((length, w, 0))
                self._back(self.size - length, w)
                return out
            gap, w = self.gaps.pop(0)
            if gap >= self.min_cut:
                out.append((gap, w, self.size - gap))
                length -= gap
            self.closed.append(w)
        return out

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _back(self, gap: int, w: int) -> None:
        if gap:
            insort(self.gaps, (gap, w))
        else:
            self.closed.append(w)


def pack_pieces(docs: DataFrame, path: str, size: int, windows: int, min_cut: int, end_id: int) -> DataFrame:
    """Tokenize and pack each partition; a row per piece, ``open`` where its window isn't full yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, packer = TaskContext.get().partitionId(), encoder(path), Packer(size, windows, min_cut)
        end, held = int(end_id).to_bytes(4, "little"), {}
        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode_bytes(text.as_py()) + end
                total, at = len(ids) // 4, 0
                for length, w, offset in packer.place(total):
                    held.setdefault(w, []).append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, part, w, offset))
                    at += length
            for w in packer.closed:
                done += _closed(held.pop(w), False)
            packer.closed.clear()
            if done:
                yield _batch(done)
        rest = [p for w in sorted(held) for p in _closed(held[w], True)]
        if rest:
            yield _batch(rest)

    return lean(docs).mapInArrow(run, PIECE)


def _closed(pieces: list[tuple], still_open: bool) -> list[tuple]:
    used = sum(p[2] for p in pieces)
    return [(*p, used, still_open) for p in pieces]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def merge_round(left: DataFrame, size: int, windows: int, fan: int) -> DataFrame:
    """Merge the open windows of ``fan`` partitions each: the largest pieces first, each where it fits best.

    The input of a task is bounded: fan * windows windows. It leaves ``windows`` open windows at most.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "part", "window", "offset"], ascending=[False, True, True, True, True, True], kind="stable")
        group = int(pdf["part"].iloc[0]) // fan
        packer = Packer(size, len(pdf) + 1, size + 1)
        spots = [packer.place(int(n))[0] for n in pdf["length"]]
        open_now = {w for _, w in sorted(packer.gaps, reverse=True)[:windows]}  # the emptiest stay open
        out = pdf.assign(part=group, window=[w for _, w, _ in spots], offset=[o for _, _, o in spots])
        out["used"] = out.groupby("window")["length"].transform("sum")
        out["open"] = out["window"].isin(open_now)
        return out

    by = F.expr(f"part div {fan}").alias("g")
    # ids travel as text: pandas would turn a column with nulls into floats
    text = left.withColumn("doc_id", F.col("doc_id").cast("string"))
    return text.groupBy(by).applyInPandas(merge, PIECE.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, path: str, size: int = 2048, windows: int = 64, min_cut: int = 64, end_id: int = END_ID, fan: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, used, padded_length).

    A null text counts as empty (the end id alone). A document that occurs twice is packed twice.
    Null ids stay null. Other input columns are ignored. An empty input gives no rows. ``used``: tokens of the
    sequence; ``padded_length``: what it is padded to, ``size``, or ``used`` itself where that is a power of two. Which pieces share a sequence, and the sequence ids, follow the
    partitions of the input and the order of their rows; the contract's promises hold for any.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = stage(pack_pieces(rows, path, size, windows, min_cut, end_id), "pack-pieces")
    done = [pieces.filter("not open").withColumn("round", F.lit(0))]
    left = pieces.filter("open")
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    k = 0
    while True:
        k += 1
        merged = stage(merge_round(left, size, windows, fan), f"pack-merge{k}")
        parts = -(-parts // fan)
        if parts == 1:
            done.append(merged.withColumn("round", F.lit(k)))
            break
        done.append(merged.filter("not open").withColumn("round", F.lit(k)))
        left = merged.filter("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # round (6 bits), partition (25 bits) and window (32 bits) name a window
    sequence = F.expr("shiftleft(cast(round as long), 57) + shiftleft(part, 32) + window")
    padded = F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(size).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset", "used", padded.alias("padded_length"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
