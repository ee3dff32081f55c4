"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks by content: all windows of ``length`` words
whose smallest word k-gram hash (the anchor) lies at the same place form one block, so two equal
windows always lie in blocks with equal anchors. The index holds each block once, at its first place: the smallest id that holds it, and the
position there. Where two blocks have the same anchor and differ, the index holds their windows, too, one by one.

A document is parsed greedily from left to right against the whole index (``parse``): a factor begins at the first window that the index (or the document itself,
further left) holds and goes on as long as the next window continues the same source, so it is the longest copy of what that source says,
(start, length, source document, source start), and at least ``length`` words long; the next factor begins where it ends or later. Factors become the
duplicate spans; at their boundaries, the windows that begin in a factor, reach over its end and are held by the index are covered too (``at_boundaries``). Nothing
else is covered: a window that no factor holds begins in one, as the next factor would otherwise begin with it.

The index is distributed and only hashes travel. Three passes read the texts where they are: (1) anchors, to
find those that several documents hold; (2) blocks at such anchors; (3) windows of the first holder of
each block that differs from another one at its anchor. What a pass needs from the one before is passed as a
bitmap of fixed size (8 MiB); a bit set by chance adds rows to a pass and changes no result.
Keys across documents are 128 bits (anchor and block, anchor and window); a repeat within a document is compared word by word.
The last step brings the found keys and their sources back to the texts, which parse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, bitmap_bytes, bits_of, lean, stage, table, test_bits
from textloom.llm.words import P, Q, Ranges, U, bounds, mix, slices, word_hashes

LENGTH = 20
GRAM = 6
LOG2 = 26
NULL_ID = -(2**63)

#: A factor: ``length`` words from ``start`` on are those of document ``doc`` from word ``from`` on.
FACTOR = "struct<start:long,length:long,doc:long,from:long>"


class Slice:
    """Words, windows and blocks of some texts, held end to end in ``data`` (text i: offsets[i] to offsets[i + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.starts, self.ends, self.word_at = bounds(data, offsets)
        self.n_words = np.diff(self.word_at)
        self.text_of = np.repeat(np.arange(len(offsets) - 1), self.n_words)
        total = len(self.starts)
        at = np.arange(max(total - length + 1, 0))
        self.windows = at[at + length <= self.word_at[self.text_of[: len(at)] + 1]]
        if not len(self.windows):
            self.anchor = self.block = np.empty(0, dtype=U)
            self.first = self.last = self.block_text = np.empty(0, dtype=np.int64)
            return
        words = self.words = word_hashes(data, self.starts, self.ends)
        self.ranges = Ranges(words)
        g = np.zeros(total - gram + 1, dtype=U)
        for t in range(gram):
            g = g * P + words[t : total - gram + 1 + t]
        low = _least(mix(g), length - gram + 1)[self.windows]
        text = self.text_of[self.windows]
        begins = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1]))))
        ends = np.concatenate((begins[1:], [len(low)]))
        self.block_size = ends - begins
        self.first, self.last = self.windows[begins], self.windows[ends - 1]
        self.anchor, self.block_text = low[begins], text[begins]
        self.block = self.ranges.hash(self.first, self.last + length)

    def window_hash(self) -> np.ndarray:
        return self.ranges.hash(self.windows, self.windows + self.length)


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive numbers, by doubling."""
    done, out = 1, x
    while done < span:
        by = min(done, span - done)
        out = np.minimum(out[:-by], out[by:])
        done += by
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + b * Q)


def once(*keys: np.ndarray) -> np.ndarray:
    """Positions of the first of each combination."""
    mixed = keys[0]
    for k in keys[1:]:
        mixed = pair(mixed, k)
    return np.sort(np.unique(mixed, return_index=True)[1])


def _scan(docs: DataFrame, each: Callable[[Slice, np.ndarray], tuple[np.ndarray, ...]], names: list[str], length: int, gram: int) -> DataFrame:
    """Rows of 64-bit numbers from each slice of the texts; ``each`` sees the ids of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            for at, to, data, offsets in slices(b.column("text")):
                s = Slice(data, offsets, length, gram)
                if len(s.windows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in each(s, ids[at:to])], names=names)

    return lean(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, spans, factors, kept_text).

    A word is removed if a window of ``length`` words that covers it also starts earlier: in a document with
    a smaller id, or further left in the same one. Windows are judged on the input. ``spans``:
    the removed ranges of words (start, end exclusive). ``factors``: the parse (``FACTOR``); its sources are first places, in a document with a smaller id or
    further left in the same one (where several rows share the source's id, in one of them). ``kept_text``: the other words joined by one
    space. Null texts have no words. A null id counts as the smallest; rows with equal ids count
    as one document that doesn't repeat itself across rows. Other columns are ignored; an empty input gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # 1: anchors that several documents hold
    def anchors_of(s: Slice, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        held = once(s.anchor, ids[s.block_text].view(U))
        return np.unique(s.anchor[held], return_counts=True)

    anchors = _scan(base, anchors_of, ["anchor", "n"], length, gram)
    shared = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    known = spark.sparkContext.broadcast(bitmap_bytes(bits_of(shared, "anchor", LOG2), LOG2))

    # 2: blocks at such anchors, and who holds each first
    def blocks_of(s: Slice, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        hit = test_bits(known.value, s.anchor, LOG2)
        anchor, block, doc = s.anchor[hit], s.block[hit], ids[s.block_text[hit]]
        at = (s.first - s.word_at[s.block_text])[hit]
        some = once(anchor, block, doc.view(U))
        return doc[some], anchor[some], block[some], at[some]

    held = stage(_scan(base, blocks_of, ["doc", "anchor", "block", "at"], length, gram), "substring-blocks")
    source = F.min(F.struct("doc", "at")).alias("source")
    blocks = held.groupBy("anchor", "block").agg(source, F.count("*").alias("n"))
    blocks = stage(blocks.select("anchor", "block", F.col("source.doc").alias("holder"), F.col("source.at").alias("from"), "n"), "substring-holders")
    again = attach(held.drop("at"), blocks.filter("n > 1"), ["anchor", "block"], "n", F.col("doc")).filter("doc > holder").select("doc", "anchor", "block", "holder", "from")
    variants = stage(blocks.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "substring-variants")
    differing = attach(blocks, variants, ["anchor"], "m", F.col("block")).filter("m is not null").select("anchor", "block", "holder")

    # 3: windows of the first holders of blocks that differ
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            a, b, d = (r.column(c).to_numpy().view(U) for c in ("anchor", "block", "holder"))
            yield pa.RecordBatch.from_arrays([pa.array(pair(pair(a, b), d).view(np.int64))], names=["key"])

    edges = spark.sparkContext.broadcast(bitmap_bytes(bits_of(differing.mapInArrow(keys_of, "key long"), "key", LOG2), LOG2))

    def windows_of(s: Slice, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        hit = test_bits(edges.value, pair(pair(s.anchor, s.block), ids[s.block_text].view(U)), LOG2)
        some = np.repeat(hit, s.block_size)
        anchor, doc = np.repeat(s.anchor[hit], s.block_size[hit]), np.repeat(ids[s.block_text[hit]], s.block_size[hit])
        at = s.windows[some]
        window = s.ranges.hash(at, at + s.length)
        at -= s.word_at[s.text_of[at]]
        some = once(anchor, window, doc.view(U))
        return doc[some], anchor[some], window[some], at[some]

    at_edges = stage(_scan(base, windows_of, ["doc", "anchor", "window", "at"], length, gram), "substring-windows")
    firsts = at_edges.groupBy("anchor", "window").agg(source, F.count("*").alias("n")).filter("n > 1")
    firsts = stage(firsts.select("anchor", "window", F.col("source.doc").alias("holder"), F.col("source.at").alias("from"), "n"), "substring-firsts")
    twice = attach(at_edges.drop("at"), firsts, ["anchor", "window"], "n", F.col("doc")).filter("doc > holder").select("doc", "anchor", "window", "holder", "from")

    # spans: the keys go to their documents
    per_doc = again.select("doc", F.lit(True).alias("whole"), "anchor", F.col("block").alias("key"), "holder", "from").union(twice.select("doc", F.lit(False), "anchor", "window", "holder", "from"))
    keys = lambda whole: F.collect_list(F.when(F.col("whole") == whole, F.struct("anchor", "key", "holder", "from")))
    per_doc = per_doc.groupBy("doc").agg(keys(True).alias("blocks"), keys(False).alias("windows"))

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in slices(b.column("text")):
                yield _spans(b.slice(at, to - at), Slice(data, offsets, length, gram))

    out = base.join(per_doc, "doc", "left").select("doc", "text", "blocks", "windows")
    out = lean(out).mapInArrow(spans_of, f"doc long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, factors array<{FACTOR}>, kept_text string")
    real = lambda c: F.when(c != NULL_ID, c).cast(kind)
    factors = F.transform("factors", lambda f: f.withField("doc", real(f["doc"])))
    return out.select(real(F.col("doc")).alias("doc_id"), "n_words", "n_removed", "spans", factors.alias("factors"), "kept_text")


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(text, anchor and key in one number, source document, source position) of all entries of the lists, ordered by the first two as one number."""
    flat = lists.flatten()
    a, k, doc, at = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "key", "holder", "from"))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    key = pair(np.repeat(np.arange(len(lists)), sizes).astype(U), pair(a.view(U), k.view(U)))
    order = np.argsort(key)
    return key[order], doc[order], at[order]


def _look_up(keys: np.ndarray, index: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, source document, source position) of each key."""
    names, doc, at = index
    if not len(names):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[place] == keys, doc[place], at[place]


def parse(at: np.ndarray, text: np.ndarray, doc: np.ndarray, source: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """The greedy factors (text, start, length, source document, source start).

    The arrays describe the windows that the index holds, left to right: position, text, source document and position. A factor goes on while the next window
    continues its source. What of a run lies before the end of the factor before it is left to the boundary check.
    """
    if not len(at):
        return []
    goes_on = (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1]) & (doc[1:] == doc[:-1]) & (source[1:] == source[:-1] + 1)
    begin = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((begin[1:], [len(at)])) - 1
    out, done = [], -1
    for t, s, e, d, p in zip(text[begin].tolist(), at[begin].tolist(), (at[last] + length).tolist(), doc[begin].tolist(), source[begin].tolist()):
        start = max(s, done)  # positions count on through the texts, so a factor never reaches into the next one
        if e - start >= length:
            out.append((t, start, e - start, d, p + start - s))
            done = e
    return out


def at_boundaries(at: np.ndarray, factors: list[tuple[int, int, int, int, int]], length: int) -> np.ndarray:
    """The windows that the index holds and that begin in a factor and reach over its end. All others lie within factors."""
    if not factors:
        return at[:0]
    begin = np.array([f[1] for f in factors])
    end = begin + np.array([f[2] for f in factors])
    of = np.maximum(np.searchsorted(begin, at, side="right") - 1, 0)
    return at[(at >= begin[of]) & (at < end[of]) & (at + length > end[of])]


def _repeats(s: Slice, here: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows also start further left in their text, the place of the first one); compared word by word, not by hash alone."""
    _, first, where = np.unique(pair(here, text.astype(U)), return_index=True, return_inverse=True)
    earlier = first[where]
    again = np.flatnonzero(earlier != np.arange(len(here)))
    a, b = s.windows[again], s.windows[earlier[again]]
    same = text[again] == text[earlier[again]]
    for t in range(s.length):
        same &= s.words[a + t] == s.words[b + t]
    local = np.zeros(len(here), dtype=bool)
    local[again[same]] = True
    return local, s.windows[earlier]


def _spans(rows: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
    """The result rows of a slice: its texts are parsed; factors, and windows over their ends, are covered."""
    count, total = len(s.n_words), len(s.starts)
    change = np.zeros(total + 1, dtype=np.int64)
    factors: list[tuple[int, int, int, int, int]] = []
    if len(s.windows):
        here, text = s.window_hash(), s.text_of[s.windows]
        own = rows.column("doc").to_numpy()
        in_block = s.windows - np.repeat(s.first, s.block_size)
        found, doc, source = (np.repeat(x, s.block_size) for x in _look_up(pair(s.block_text.astype(U), pair(s.anchor, s.block)), _listed(rows.column("blocks"))))
        source = source + in_block
        single = _look_up(pair(text.astype(U), pair(np.repeat(s.anchor, s.block_size), here)), _listed(rows.column("windows")))
        use = ~found & single[0]
        found, doc, source = found | use, np.where(use, single[1], doc), np.where(use, single[2], source)
        local, first = _repeats(s, here, text)
        use = ~found & local
        found, doc, source = found | use, np.where(use, own[text], doc), np.where(use, first - s.word_at[text], source)
        at = s.windows[found]
        factors = parse(at, text[found], doc[found], source[found], s.length)
        np.add.at(change, [f[1] for f in factors], 1)
        np.add.at(change, [f[1] + f[2] for f in factors], -1)
        over = at_boundaries(at, factors, s.length)
        np.add.at(change, over, 1)
        np.add.at(change, over + s.length, -1)
    covered = np.cumsum(change)[:total] > 0
    bounds = np.zeros(total + 1, dtype=bool)
    bounds[s.word_at] = True
    inside = np.concatenate((covered, [False]))
    left = np.concatenate(([False], covered))
    begin, end = np.flatnonzero(inside & (~left | bounds)), np.flatnonzero(left & (~inside | bounds))
    span_at = np.searchsorted(begin, s.word_at)
    shift = np.repeat(s.word_at[:-1], np.diff(span_at))
    spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - shift), pa.array(end - shift)], names=["start", "end"]))
    # the kept words, one space after each but the last of its text
    kept = np.flatnonzero(~covered)
    data = s.data.copy()
    show = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(show, s.starts[kept], 1)
    np.add.at(show, s.ends[kept], -1)
    shown = np.cumsum(show)[:-1] > 0
    inner = kept[:-1][s.text_of[kept[:-1]] == s.text_of[kept[1:]]]
    data[s.ends[inner]] = 0x20
    shown[s.ends[inner]] = True
    offsets = np.concatenate(([0], np.cumsum(shown)))[s.offsets].astype(np.int32)
    text = pa.StringArray.from_buffers(count, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[shown].tobytes()))
    removed = np.bincount(s.text_of[covered], minlength=count)
    of, start, size, doc, source = (np.array(x, dtype=np.int64) for x in (zip(*factors) if factors else [()] * 5))
    parts = pa.StructArray.from_arrays([pa.array(start - s.word_at[of]), pa.array(size), pa.array(doc), pa.array(source)], names=["start", "length", "doc", "from"])
    parsed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(count + 1)), pa.int32()), parts)
    return pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(s.n_words), pa.array(removed), spans, parsed, text], names=["doc", "n_words", "n_removed", "spans", "factors", "kept_text"])


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
win AS (SELECT doc_id, p, x, CASE WHEN count(*) OVER f = 20 THEN string_agg(x, ' ') OVER f END AS k FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
dup AS (SELECT doc_id, p, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM win),
cov AS (SELECT doc_id, p, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM dup)
SELECT d.doc_id, count(p) AS n_words, count(*) FILTER (c) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY p) FILTER (NOT c), '')) AS kept_sha256
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id GROUP BY d.doc_id
"""
