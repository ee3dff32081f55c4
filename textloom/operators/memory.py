"""Translation memory, deduplication and batching."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.keep import keeper
from textloom.operators.skew import join_back, largest
from textloom.operators.store import TRANSLATED, rank

MAX_SEGMENTS, MAX_CHARS = 10, 4000


def best_translations(segments: DataFrame, per_document: bool = False, need_text: bool = False, texts: bool = True) -> DataFrame:
    """The best stored translation per (src_hash, cfg_hash): confirmed, then edited, then machine; the lowest id among equals.

    The choice is a minimum over a struct, so it is combined before the shuffle and a hash with many copies stays one row per task. Without
    ``texts``, the struct has ids and states only.
    """
    rows = segments.filter(F.col("status").isin(list(TRANSLATED)) & F.col("tgt_text").isNotNull())
    if need_text:
        rows = rows.filter("tgt_text <> ''")
    keys = ["src_hash", "cfg_hash", *(["doc_id"] if per_document else [])]
    picked = F.min(F.struct(rank(F.col("status")).alias("rank"), "id", F.col("doc_id").alias("from_doc"), *(["tgt_text"] if texts else []), "status", *(["review_flag"] if texts else []))).alias("best")
    return rows.groupBy(*keys).agg(picked)


def backfill(new: DataFrame, stored: DataFrame, cfg_hash: str) -> DataFrame:
    """Fill ``new`` segments (src_hash, doc_id, translatable) from the document's own memory, else from other documents'.

    Adds tgt_text, status, review_flag and cfg_hash; what has no match is pending. Rows that aren't translatable have no cfg_hash.
    """
    here = stored.filter(F.col("cfg_hash") == cfg_hash)
    base = new.drop("tgt_text", "status", "review_flag", "cfg_hash")
    own = best_translations(here, per_document=True).select(F.col("src_hash").alias("h1"), F.col("doc_id").alias("d1"), F.col("best").alias("own"))
    out = base.join(own, F.col("translatable") & (F.col("src_hash") == F.col("h1")) & (F.col("doc_id") == F.col("d1")), "left").drop("h1", "d1")
    out = join_back(out, best_of_others(here), "src_hash", spread=F.monotonically_increasing_id(), condition=F.col("translatable"))
    cross = F.when(F.col("first.from_doc") != F.col("doc_id"), F.col("first")).otherwise(F.col("second"))
    best = F.coalesce(F.col("own"), cross)
    return out.select(
        *base.columns, best["tgt_text"].alias("tgt_text"), F.coalesce(best["status"], F.lit("pending")).alias("status"), F.coalesce(best["review_flag"], F.lit(False)).alias("review_flag"),
        F.when(F.col("translatable"), F.lit(cfg_hash)).alias("cfg_hash"),
    )


def best_of_others(stored: DataFrame, texts: bool = True) -> DataFrame:
    """(src_hash, first, second): the best translation of a hash, and the best from any other document than that one.

    Both are minima that combine before the shuffle: the second is the least among those of documents other than the first's, of which each
    document's best is one; the two best documents of each task are enough to know it.
    """
    per_doc = best_translations(stored, per_document=True, texts=texts).select("src_hash", "best")
    two = per_doc.withColumn("__k", F.row_number().over(Window.partitionBy("src_hash").orderBy("best"))).filter("__k <= 2")
    return two.groupBy("src_hash").agg(F.min(F.when(F.col("__k") == 1, F.col("best"))).alias("first"), F.min(F.when(F.col("__k") == 2, F.col("best"))).alias("second"))


def look_up(todo: DataFrame, stored: DataFrame, cfg_hash: str, texts: bool = True) -> DataFrame:
    """Run-time memory: a hit in another document with the same hash and settings and a text; the state before the run counts.

    Adds tm_id, tm_text and tm_status; without ``texts`` no text is moved, and tm_text is left out.
    """
    here = stored.filter((F.col("cfg_hash") == cfg_hash) & (F.col("tgt_text") != ""))
    out = join_back(todo, best_of_others(here, texts), "src_hash", spread=F.col("id"))
    hit = F.when(F.col("first.from_doc") != F.col("doc_id"), F.col("first")).otherwise(F.col("second"))
    return out.select(*todo.columns, hit["id"].alias("tm_id"), *([hit["tgt_text"].alias("tm_text")] if texts else []), hit["status"].alias("tm_status"))


def deduplicate(todo: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``lead`` (struct of the order columns and id): the first row of each src_hash, which stands for all of them, and ``copies``.

    The group minimum is combined before the shuffle and written once; joining it back deals the copies of a crowded hash over many tasks.
    """
    lead = todo.groupBy("src_hash").agg(F.min(F.struct(*order, "id")).alias("lead"), F.count("*").alias("copies"))
    lead = keeper(todo.sparkSession)(lead, "leads")
    heavy = largest(lead.filter("src_hash is not null").select(F.col("src_hash").alias("__key"), F.col("copies").alias("__n")))
    return join_back(todo.filter("src_hash is not null"), lead, "src_hash", spread=F.col("id"), heavy=heavy)


BATCH_ROWS = "block int, doc_id long, id long, after int, starts array<int>, summary string"


def batches(todo: DataFrame, max_segments: int = MAX_SEGMENTS, max_chars: int = MAX_CHARS, length: Column | None = None) -> DataFrame:
    """(doc_id, id, batch): the greedy batch of each segment in its document: a new one begins after ``max_segments`` segments or once ``max_chars`` characters are reached.

    ``length``: the characters of a segment, if they are known without its text.

    Where a batch ends depends on where it began, all the way back to the begin of the document; still no task holds a document. Rows are
    sorted into blocks by ranges of (doc_id, seq, id), so that a long document spans several. At the begin of a block, a batch is open that has some
    segments already, and the next one begins at one of the first ``max_segments`` places. A block works out what follows from each of these; the
    blocks are then put in a chain by what they leave open (some numbers a block), and each row looks up the place that came true.
    """
    spark = todo.sparkSession
    order = ["doc_id", "seq", "id"]
    rows = todo.select("doc_id", "seq", "id", (F.length("src_text") if length is None else length).alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    walked = keeper(spark)(rows.mapInArrow(_walk_blocks(max_segments, max_chars), BATCH_ROWS), "batches")
    chain = spark.createDataFrame(_chained(walked.filter("summary is not null").select("block", "summary").collect(), max_segments, max_chars), "block int, entry int, base long")
    out = walked.filter("summary is null").join(F.broadcast(chain), "block")  # a row a block
    led = F.col("starts")[F.col("entry")]
    return out.select("doc_id", "id", (F.when(F.col("starts").isNull(), F.col("after")).otherwise(F.col("base") + led - 1)).cast("long").alias("batch"))


def _next_starts(lengths: np.ndarray, max_segments: int, max_chars: int) -> list[int]:
    """For each place where a batch may begin, where the next one begins: by binary search on running sums."""
    sums = np.concatenate(([0], np.cumsum(lengths)))
    full = np.searchsorted(sums, sums[:-1] + max_chars, side="left")
    return np.minimum(np.maximum(full, np.arange(len(lengths)) + 1), np.arange(len(lengths)) + max_segments).tolist()


def _chain(nexts: list[int], entry: int) -> list[int]:
    out = []
    while entry < len(nexts):
        out.append(entry)
        entry = nexts[entry]
    return out


def _walk_blocks(max_segments: int, max_chars: int):
    """Rows (block, doc_id, id, after, starts): the batch of a row whose document begins in this block, else the batches begun up to it for each entry; and a summary."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        first, tail = None, None  # of the first and of the last document

        def close() -> pa.RecordBatch:
            nonlocal first, tail
            doc, ids = held[0].column("doc_id")[0].as_py(), pa.concat_arrays([h.column("id") for h in held])
            lengths = np.concatenate([h.column("n").fill_null(0).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)
            n, nexts = len(lengths), _next_starts(lengths, max_segments, max_chars)
            held.clear()

            def left(starts: list[int]) -> tuple[int, int, int]:
                """(segments, characters, batches) since the last begin, and begun in all."""
                return (n - starts[-1], int(lengths[starts[-1] :].sum()), len(starts)) if starts else (n, int(lengths.sum()), 0)

            ways = [_chain(nexts, e) for e in range(min(max_segments, n + 1))] if first is None else [_chain(nexts, 0)]
            begun = np.zeros((len(ways), n), dtype=np.int64)
            for w, starts in enumerate(ways):
                begun[w, starts] = 1
            begun = np.cumsum(begun, axis=1)
            if first is None:
                first = (doc, n, lengths[:max_segments].tolist(), [left(s) for s in ways])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(ways), pa.int32()), pa.array(begun.T.ravel(), pa.int32()))
            else:
                lists = pa.nulls(n, pa.list_(pa.int32()))
            tail = (doc, left(ways[0]))
            return _batch_rows(pa.array([block] * n, pa.int32()), pa.array([doc] * n, pa.int64()), ids, pa.array(begun[0] - 1, pa.int32()), lists, pa.nulls(n, pa.string()))

        for part in parts:
            docs = part.column("doc_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(docs)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column("doc_id")[0].as_py() != int(docs[a]):
                    yield close()
                held.append(part.slice(a, b - a))
        if held:
            yield close()
        if first is not None:
            yield _batch_rows(pa.array([block], pa.int32()), *(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))), pa.array([json.dumps((first, tail))]))

    return run


def _batch_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in BATCH_ROWS.split(", ")])


def _chained(summaries: list, max_segments: int, max_chars: int) -> list[tuple[int, int, int]]:
    """(block, entry, base) in order: the place in the block where its first batch begins, and the batches that its first document has begun before."""
    out, last, state = [], None, (0, 0, 0)
    for block, summary in sorted(summaries):
        (doc, n, head, ways), (end, rest) = json.loads(summary)
        segments, chars, base = state if doc == last else (0, 0, 0)
        entry = 0
        if segments:  # a batch is open: it takes segments until it is full
            while entry < n and segments + entry < max_segments and chars + sum(head[:entry]) < max_chars:
                entry += 1
        out.append((block, entry, base))
        if end != doc:
            state = rest
        elif entry < len(ways) and ways[entry][2]:
            state = (ways[entry][0], ways[entry][1], base + ways[entry][2])
        else:  # the open batch takes the whole block
            state = (segments + n, chars + sum(head[:n]), base)
        last = end
    return out


def context(segments: DataFrame, n: int) -> DataFrame:
    """Per translatable segment: ``before``, the nearest ``n`` translated texts above it in order, and ``after``, the next ``n`` source texts.

    A batch takes ``before`` of its first and ``after`` of its last segment. Untranslated rows above are skipped by carrying the last
    ``n`` translations along in a bounded fold over the running list of translated neighbours.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = segments.filter("translatable")
    translated = F.col("status").isin(list(TRANSLATED)) & F.col("tgt_text").isNotNull()
    # number the translated rows; the n above a row are those with the n numbers before it
    rows = rows.withColumn("__no", F.sum(translated.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__no", F.coalesce("__no", F.lit(0))).withColumn("after", F.collect_list("src_text").over(w.rowsBetween(1, n)) if n else F.array().cast("array<string>"))
    known = rows.filter(translated).select(F.col("doc_id").alias("__d"), (F.col("__no") + 1).alias("__k"), F.col("tgt_text").alias("__t"))
    w2 = Window.partitionBy("__d").orderBy("__k").rowsBetween(-(n - 1), 0) if n else None
    upto = known.withColumn("before", F.collect_list("__t").over(w2)).drop("__t") if n else known.withColumn("before", F.array().cast("array<string>")).drop("__t")
    out = rows.join(upto, (F.col("doc_id") == F.col("__d")) & (F.col("__no") == F.col("__k")), "left")
    return out.select(*segments.columns, F.coalesce("before", F.array().cast("array<string>")).alias("before"), "after")


def neighbours(segments: DataFrame, n: int) -> DataFrame:
    """(id, above, below) per translatable segment: the ids of the nearest ``n`` translated segments above it in order, and of the next ``n`` segments.

    As ``context``, without moving a text: ids are small, and only those of a batch's ends are looked up.
    """
    done = F.col("status").isin(list(TRANSLATED)) & F.col("tgt_text").isNotNull()
    rows = segments.filter("translatable").select("doc_id", "seq", "id", done.alias("__done"))
    none = F.array().cast("array<bigint>")
    if not n:
        return rows.select("id", none.alias("above"), none.alias("below"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    upto = F.collect_list("id").over(Window.partitionBy("doc_id", "__done").orderBy("seq").rowsBetween(-(n - 1), 0))
    rows = rows.withColumn("__upto", F.when(F.col("__done"), upto))  # a translated row and those before it
    above = F.last("__upto", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("id", F.coalesce(above, none).alias("above"), F.collect_list("id").over(w.rowsBetween(1, n)).alias("below"))


def cap_context(before, after, limit: int = 3000):
    """Drop the farthest texts above, then the farthest below, until both hold at most ``limit`` characters."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    fits = lambda kept, other: total(kept) + other <= limit
    tails = F.transform(F.sequence(F.lit(0), F.size(before)), lambda k: F.slice(before, k + 1, F.greatest(F.size(before) - k, F.lit(0))))
    b = F.coalesce(F.try_element_at(F.filter(tails, lambda x: fits(x, total(after))), F.lit(1)), F.array().cast("array<string>"))
    heads = F.transform(F.sequence(F.lit(0), F.size(after)), lambda k: F.slice(after, F.lit(1), F.size(after) - k))
    a = F.coalesce(F.try_element_at(F.filter(heads, lambda x: fits(x, total(b))), F.lit(1)), F.array().cast("array<string>"))
    return b, a
