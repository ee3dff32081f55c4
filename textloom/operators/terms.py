"""Glossary, term candidates, consistency, and the impact of changed terms.

Terms are found by an automaton over all of them: one pass over a text gives every term it contains, however many terms there are. A
glossary of more than ``AUTOMATON_CHARS`` characters is split by a hash into several automata, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.automaton import Automaton
from textloom.functions.lattice import pieces
from textloom.operators.keep import keeper
from textloom.operators.store import TRANSLATED
from textloom.operators.words import chinese_words

#: Characters of the terms of one automaton, at most; about 20 bytes each in every task.
AUTOMATON_CHARS = 2_000_000
#: Bytes of the rows of terms that are sent to all tasks; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def automata(words: DataFrame) -> list[Automaton]:
    """Automata that together hold the distinct words of the only column: one, unless they are more than ``AUTOMATON_CHARS`` characters."""
    (name,) = words.columns
    used = words.filter(F.col(name) != "").distinct()
    parts = max(1, -(-(used.agg(F.sum(F.length(name))).first()[0] or 0) // AUTOMATON_CHARS))
    shard = F.pmod(F.xxhash64(name), F.lit(parts))
    return [Automaton([r[0] for r in used.filter(shard == i).collect()]) for i in range(parts)]


def found_in(automaton: Automaton, text: Column) -> Column:
    """The words of the automaton that the text contains, each once."""

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        names, out = pa.array(automaton.words, pa.string()), [pa.array([], pa.list_(pa.string()))]
        for piece in pieces(texts, 4 << 20):
            rows, words = automaton.find(piece)
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(piece) + 1)), pa.int32()), names.take(pa.array(words, pa.int64()))))
        return pa.concat_arrays(out)

    return find(text)


def everywhere(df: DataFrame) -> DataFrame:
    """Sent to all tasks if its rows are small enough together, which is counted."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def containing(segments: DataFrame, terms: DataFrame, text: str, needle: str = "src") -> DataFrame:
    """Rows (segment, term) where ``text`` contains the term's ``needle``, which isn't empty."""
    used = terms.filter(F.col(needle) != "")
    known = everywhere(used.withColumn("__hit", F.col(needle)))
    found = [segments.withColumn("__hit", F.explode(found_in(a, F.col(text)))) for a in automata(used.select(needle))]
    return union(found).join(known, "__hit").select(*segments.columns, *used.columns)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# ---- glossary ----


def effective_hash(terms: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted lines of source and candidates; notes and order don't count."""
    lines = F.array_sort(F.collect_list(T.term_line(F.col("src"), F.col("cands"))))
    return terms.agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("terms_hash"))


def add_term(terms: DataFrame, src: str, cands: list[str], note: str = "") -> DataFrame:
    """Replace the first entry of ``src`` or append one."""
    src = src.strip()
    some = [c.strip() for c in "|".join(cands).split("|") if c.strip()][:3]
    if not src or not some:
        raise ValueError("a term needs a source and a candidate")
    hit = terms.filter(F.col("src") == src).agg(F.min("ord")).first()[0]
    made = F.array(*map(F.lit, some))
    if hit is not None:
        this = F.col("ord") == hit
        return terms.withColumn("cands", F.when(this, made).otherwise(F.col("cands"))).withColumn("note", F.when(this, F.lit(note)).otherwise(F.col("note")))
    last = terms.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord"))
    return terms.unionByName(last.select(F.col("ord").cast("int"), F.lit(src).alias("src"), made.alias("cands"), F.lit(note).alias("note")), allowMissingColumns=True)


def remove_term(terms: DataFrame, src: str) -> DataFrame:
    return terms.filter(F.col("src") != src.strip())


def merge_glossary(terms: DataFrame, other: DataFrame) -> DataFrame:
    """Append the terms of ``other`` whose source is unknown, the first of each, in its order."""
    first = other.groupBy("src").agg(F.min("ord").alias("ord")).select("src", "ord")
    fresh = other.join(first, ["src", "ord"], "left_semi").join(terms.select("src"), "src", "left_anti")
    top = terms.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__top"))
    return terms.unionByName(fresh.join(F.broadcast(top)).withColumn("ord", (F.col("__top") + F.col("ord")).cast("int")).select(*terms.columns))


def with_occurrences(terms: DataFrame, cache: DataFrame) -> DataFrame:
    """The glossary decides which terms there are and their order; the cache adds counts, 1 where it has none."""
    seen = cache.groupBy("src").agg(F.max("occurrences").alias("__n"))
    return terms.drop("occurrences").join(seen, "src", "left").withColumn("occurrences", F.coalesce("__n", F.lit(1)).cast("int")).drop("__n")


def not_in_glossary(induced: DataFrame, terms: DataFrame) -> DataFrame:
    return induced.join(terms.select("src"), "src", "left_anti")


def merge_induced(parsed: DataFrame) -> DataFrame:
    """(src, cands, note) over batches: candidates in order of appearance, the first three; the newest note that isn't empty."""
    cands = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "pos", "cands"))), lambda x: x["cands"]))
    note = F.max(F.when(F.col("note") != "", F.struct("batch", "pos", "note")))["note"]
    return parsed.groupBy("src").agg(F.slice(F.array_distinct(cands), 1, 3).alias("cands"), F.coalesce(note, F.lit("")).alias("note"))


def candidate_words(docs: DataFrame, lang: str = "en", top: int = 300, least: int = 2, text: str = "text", order: str = "doc_id", dictionary: DataFrame | None = None) -> DataFrame:
    """(word, n, first) of the ``top`` most frequent words that occur ``least`` times; ties by first occurrence.

    Chinese texts are cut into words with ``dictionary`` (``words.learn_words``), else into pairs of characters. Counts and first documents are
    plain numbers, which combine in a hash table before the shuffle; places are looked for only in the first documents of the words that may be
    among the top, all that are level with the last one included.
    """
    spark = docs.sparkSession
    def found(part: DataFrame) -> DataFrame:
        if lang.startswith("zh") and dictionary is not None:
            return chinese_words(part, dictionary, text, order).select(F.col(order).alias("__d"), F.col("place").alias("__p"), "word")
        c = F.regexp_replace(F.col(text), T.RUBY_SLOT, "")
        words = F.concat(T.katakana_runs(c), T.han_bigrams(c)) if lang.startswith("ja") else T.han_bigrams(c) if lang.startswith("zh") else T.latin_words(c)
        return part.select(F.col(order).alias("__d"), F.posexplode(words).alias("__p", "word"))

    first = F.when(F.min(F.col("__d").isNotNull()), F.min("__d"))  # null is before all others
    agg = found(docs).groupBy("word").agg(F.count("*").alias("n"), first.alias("__d")).filter(F.col("n") >= least)
    agg = keeper(spark)(agg.withColumn("place", F.struct((-F.col("n")).alias("n"), "__d")), "words")
    last = agg.orderBy("place").limit(top).agg(F.max("place").alias("last"))
    level = agg.join(F.broadcast(last), F.col("place") <= F.col("last")).select(F.col("word").alias("__word"), "n", F.col("__d").alias("__first"))
    level = keeper(spark)(level, "top")  # at most ``top`` words and those of one document
    few = docs.join(F.broadcast(level.select("__first").distinct()), F.col(order).eqNullSafe(F.col("__first")), "left_semi")
    places = found(few).join(F.broadcast(level), (F.col("word") == F.col("__word")) & F.col("__d").eqNullSafe(F.col("__first")))
    return places.groupBy("word", "n", "__d").agg(F.min("__p").alias("__p")).select("word", "n", F.struct("__d", "__p").alias("first")).orderBy(F.desc("n"), "first").limit(top)


def bridging_bigrams(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Han bigrams across the border of one document and the next, once other characters are dropped.

    Only the first and last Han character of a document travel. Numbering ranges of documents keeps it off one task.
    """
    from textloom.operators.store import numbered

    chars = F.regexp_extract_all(F.col(text), F.lit(T.HAN), F.lit(0))
    ends = docs.select(F.col(order).alias("__d"), F.try_element_at(chars, F.lit(1)).alias("a"), F.try_element_at(chars, F.lit(-1)).alias("z")).filter("a is not null")
    numbered = numbered(ends, ["__d"], "__n")
    nxt = numbered.select((F.col("__n") - 1).alias("__n"), F.col("a").alias("b"))
    return numbered.join(nxt, "__n").select(F.concat("z", "b").alias("word"))


# ---- consistency ----


def consistency(segments: DataFrame, terms: DataFrame, keep: int = 50) -> DataFrame:
    """Per term: hits in sources, occurrences of its candidates in targets, status, and the first suspicious segments.

    ``terms`` (ord, src, cands). A term is missing if the source has it and no target has a candidate. A segment is suspicious if it
    is translated, its source has the term and its target no candidate. The segments are read once; each task reduces what it finds to a
    row a term before anything is shuffled.
    """
    segs = segments.filter("translatable")
    each = terms.select("ord", F.explode("cands").alias("cand")).withColumn("low", F.lower(T.strip(F.col("cand"))))
    none = F.lit(None)
    known = terms.select(F.lit("src").alias("kind"), F.col("src").alias("word"), "ord", "cands", none.cast("string").alias("cand"))
    known = known.unionByName(each.select(F.lit("cand").alias("kind"), F.col("low").alias("word"), "ord", none.cast("array<string>").alias("cands"), "cand"))
    target = F.coalesce("tgt_text", F.lit(""))
    tagged = lambda kind, words: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    found = [F.flatten(F.array(*[tagged("src", found_in(a, F.col("src_text"))) for a in automata(terms.select("src"))], *[tagged("cand", found_in(a, F.lower(target))) for a in automata(each.select("low"))]))]
    hits = segs.select("doc_id", "seq", "id", target.alias("t"), F.col("status").isin(list(TRANSLATED)).alias("done"), F.explode(*found).alias("x"))
    hits = hits.select("*", "x.kind", "x.word").drop("x").join(everywhere(known), ["kind", "word"])
    suspect = (F.col("kind") == "src") & F.col("done") & ~T.mentions(F.col("t"), F.col("cands"))
    n = F.when(F.col("kind") == "cand", T.count_any(F.col("t"), T.variants(F.col("cand")))).otherwise(0)
    rows = hits.select("ord", "doc_id", "seq", "id", suspect.alias("suspect"), (F.col("kind") == "src").cast("long").alias("src_hits"), n.cast("long").alias("candidate_hits"))
    out = terms.join(first_suspects(rows, keep), "ord", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("ord", "src", F.array_join("cands", "|").alias("candidates"), n("src_hits").alias("src_hits"), n("candidate_hits").alias("candidate_hits"), F.coalesce("suspicious", F.array().cast("array<bigint>")).alias("suspicious"))
    status = F.when((F.col("candidate_hits") > 0) | (F.col("src_hits") == 0), "ok").otherwise("missing")
    return out.withColumn("status", status).orderBy(F.col("status") != "missing", F.desc("src_hits"), "ord")


def first_suspects(rows: DataFrame, keep: int) -> DataFrame:
    """(ord, src_hits, candidate_hits, suspicious): sums, and the ids of the ``keep`` first suspicious rows by document and place.

    ``rows`` (ord, doc_id, seq, id, suspect, src_hits, candidate_hits). A k-smallest aggregate that combines before the shuffle: each
    partition leaves one row a term with ``keep`` entries at most; these are merged in two steps, so that no
    task gets the rows of all partitions of a term at once.
    """
    kind = "ord int, part int, src_hits long, candidate_hits long, firsts array<struct<doc_id:long,seq:long,id:long>>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, held = np.zeros((0, 3), dtype=np.int64), np.zeros((0, 4), dtype=np.int64)
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("ord", "doc_id", "seq", "id", "suspect", "src_hits", "candidate_hits")}
            sums = _summed(np.concatenate((sums, np.stack((c["ord"], c["src_hits"], c["candidate_hits"]), axis=1))))
            some = c["suspect"].astype(bool)
            held = _firsts(np.concatenate((held, np.stack([c[k][some] for k in ("ord", "doc_id", "seq", "id")], axis=1))), keep)
        at = np.searchsorted(held[:, 0], sums[:, 0], side="left"), np.searchsorted(held[:, 0], sums[:, 0], side="right")
        firsts = [[{"doc_id": d, "seq": q, "id": i} for _, d, q, i in held[a:b].tolist()] for a, b in zip(*at)]
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"ord": pa.array(sums[:, 0], pa.int32()), "part": pa.array([part] * len(sums), pa.int32()), "src_hits": sums[:, 1], "candidate_hits": sums[:, 2], "firsts": pa.array(firsts, pa.list_(pa.struct([("doc_id", pa.int64()), ("seq", pa.int64()), ("id", pa.int64())])))})

    out = rows.mapInArrow(reduce, kind)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, keep).alias("firsts")
    for key in (["ord", "part"], ["ord"]):
        out = out.groupBy(*key).agg(F.sum("src_hits").alias("src_hits"), F.sum("candidate_hits").alias("candidate_hits"), merged)
    return out.select("ord", "src_hits", "candidate_hits", F.transform("firsts", lambda x: x["id"]).alias("suspicious"))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (key, numbers) added up by key, in order of the keys."""
    keys, which = np.unique(rows[:, 0], return_inverse=True)
    out = np.zeros((len(keys), rows.shape[1]), dtype=np.int64)
    np.add.at(out, which, rows)
    out[:, 0] = keys
    return out


def _firsts(rows: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` smallest rows of each first value, in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0]) < keep]


def write_consistency(report: DataFrame, path: str) -> None:
    """The report as CSV with a mark and Chinese headers, in report order. It has a row per term, so it is written as one file."""
    import csv

    rows = report.select("src", "candidates", "src_hits", "candidate_hits", "status", F.array_join(F.col("suspicious").cast("array<string>"), " ").alias("s")).collect()
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["术语", "译名候选", "源文出现次数", "译文命中次数", "状态", "可疑段落"])
        w.writerows(map(tuple, rows))


# ---- changed terms ----


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, old_cands, new_cands) of terms that were added, removed or given other candidates; (src, cands) in, the last of repeated sources counts."""
    last = lambda d, n: d.groupBy("src").agg(F.max_by("cands", "ord").alias(n))
    out = last(old, "old_cands").join(last(new, "new_cands"), "src", "full_outer")
    return out.filter(~F.col("old_cands").eqNullSafe(F.col("new_cands")))


def impact(segments: DataFrame, diff: DataFrame) -> DataFrame:
    """(seg_id, doc_id, kind, term, old, new): "old" where a former candidate is left in a target, "missing" where a
    translated segment has the term and no current candidate. Only changed terms are looked at.

    The last former candidate that occurs is reported, even one that is still current; what is "old" isn't "missing" too. The segments are read
    once for both kinds, and only what was found is shuffled.
    """
    segs = segments.filter("translatable").select("id", "doc_id", "src_text", "tgt_text", "status")
    none = F.lit(None)
    first = F.coalesce(F.try_element_at("new_cands", F.lit(1)), F.lit(""))
    former = diff.filter("old_cands is not null").select(F.lit("old").alias("kind"), F.col("src").alias("term"), first.alias("new"), none.cast("array<string>").alias("current"), F.posexplode("old_cands").alias("pos", "word"))
    current = diff.filter(F.size("new_cands") > 0).select(F.lit("missing").alias("kind"), F.col("src").alias("term"), F.col("new_cands")[0].alias("new"), F.col("new_cands").alias("current"), F.lit(0).alias("pos"), F.col("src").alias("word"))
    done = F.col("status").isin(list(TRANSLATED)) & ~T.is_blank(F.col("tgt_text"))
    tagged = lambda kind, words: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    olds = [tagged("old", found_in(a, F.col("tgt_text"))) for a in automata(former.select("word"))]
    misses = [tagged("missing", found_in(a, F.when(done, F.col("src_text")))) for a in automata(current.select("word"))]
    hits = segs.select(F.col("id").alias("seg_id"), "doc_id", "tgt_text", F.explode(F.flatten(F.array(*olds, *misses))).alias("x")).select("seg_id", "doc_id", "tgt_text", "x.kind", "x.word")
    hits = hits.join(everywhere(former.unionByName(current)), ["kind", "word"])
    hits = hits.filter((F.col("kind") == "old") | ~F.exists("current", lambda c: F.contains(F.col("tgt_text"), c)))
    old, miss = F.col("kind") == "old", F.col("kind") == "missing"
    out = hits.groupBy("seg_id", "doc_id", "term").agg(F.max_by(F.when(old, F.struct(F.col("word").alias("old"), "new")), F.when(old, F.col("pos"))).alias("o"), F.max(F.when(miss, F.col("new"))).alias("m"))
    is_old = F.col("o").isNotNull()
    return out.select("seg_id", "doc_id", F.when(is_old, "old").otherwise("missing").alias("kind"), "term", F.when(is_old, F.col("o.old")).otherwise("").alias("old"), F.when(is_old, F.col("o.new")).otherwise(F.col("m")).alias("new"))


def issues(segments: DataFrame, terms: list[tuple[str, list[str]]], former: dict[str, list[str]] | None = None, limit: int = 3) -> DataFrame:
    """Adds ``issues``, the first ``limit`` term problems of each row in glossary order; candidates that are still current aren't former."""
    former = former or {}
    found = []
    src, tgt = F.coalesce("src_text", F.lit("")), F.coalesce("tgt_text", F.lit(""))
    for term, cands in terms:
        cands = [c for c in cands if c]
        if not term:
            continue
        old = F.lit(None).cast("string")
        for c in reversed([c for c in former.get(term, []) if c and c not in cands]):
            old = F.when(F.contains(tgt, F.lit(c)), F.lit(c)).otherwise(old)
        new = F.lit(cands[0] if cands else "")
        row = lambda kind, o, term=term, new=new: F.struct(F.lit(kind).alias("kind"), F.lit(term).alias("term"), o.alias("old"), new.alias("new"))
        issue = F.when(old.isNotNull(), row("old", F.coalesce(old, F.lit(""))))
        if cands:
            none = ~F.greatest(F.lit(False), *[F.contains(tgt, F.lit(c)) for c in cands])
            issue = issue.when(F.contains(src, F.lit(term)) & none, row("missing", F.lit("")))
        found.append(issue)
    kind = "array<struct<kind:string,term:string,old:string,new:string>>"
    return segments.withColumn("issues", F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, limit) if found else F.array().cast(kind))


def replace_all(segments: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, changes): former candidates replaced one after the other per segment; changes (seg_id, before, status_before) allow undo."""
    steps = affected.filter("old <> '' and new <> ''").groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("term", "old", "new"))).alias("steps"))
    out = segments.join(steps, F.col("id") == F.col("seg_id"), "left")
    after = F.aggregate("steps", F.col("tgt_text"), lambda t, s: F.replace(t, s["old"], s["new"]))
    out = out.withColumn("__after", F.when(F.col("tgt_text") != "", after)).withColumn("__hit", F.coalesce(F.col("__after") != F.col("tgt_text"), F.lit(False)))
    changes = out.filter("__hit").select("seg_id", F.col("tgt_text").alias("before"), F.col("status").alias("status_before"))
    new = {"tgt_text": F.when(F.col("__hit"), F.col("__after")).otherwise(F.col("tgt_text")), "status": F.when(F.col("__hit"), F.lit("human_edited")).otherwise(F.col("status"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns]), changes


def undo(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Back to the text and status before; of several changes in one operation the first counts (``ord`` if given)."""
    if "ord" in changes.columns:
        changes = changes.groupBy("seg_id").agg(F.min_by(F.struct("before", "status_before"), "ord").alias("x")).select("seg_id", "x.*")
    c = changes.select(F.col("seg_id").alias("__id"), F.col("before").alias("__b"), F.col("status_before").alias("__s"))
    out = segments.join(c, F.col("id") == F.col("__id"), "left")
    new = {"tgt_text": F.when(F.col("__id").isNotNull(), F.col("__b")).otherwise(F.col("tgt_text")), "status": F.coalesce("__s", "status")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns])


def mark(segments: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected segments back to pending."""
    ids = affected.select(F.col("seg_id").alias("__id")).distinct()
    out = segments.join(ids, F.col("id") == F.col("__id"), "left")
    return out.select(*[F.when(F.col("__id").isNotNull(), F.lit("pending")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in segments.columns])


def impact_summary(affected: DataFrame) -> DataFrame:
    return affected.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def previous_state(revisions: DataFrame, cache: DataFrame) -> DataFrame:
    """(src, cands, ord) before the newest change: the second newest snapshot, else the cache. Bad JSON falls back."""
    top = revisions.orderBy(F.desc("id")).limit(2).orderBy("id").limit(2).collect()
    if len(top) == 2:
        kind = "array<struct<src:string,candidates:array<string>,note:string>>"
        one = revisions.filter(F.col("id") == top[0]["id"]).select(F.from_json("payload", kind).alias("p"))
        rows = one.select(F.posexplode("p").alias("ord", "x")).select("x.src", F.col("x.candidates").alias("cands"), "ord").filter("src is not null")
        if not rows.isEmpty():
            return rows
    return cache.select("src", "cands", F.monotonically_increasing_id().alias("ord"))


def snapshot(revisions: DataFrame, payload: DataFrame, saved_at: float) -> DataFrame:
    """Append the payload (one row: payload) unless it equals the newest one; notes count here."""
    newest = revisions.agg(F.max_by("payload", "id").alias("__last"), F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    row = payload.join(F.broadcast(newest)).filter(~F.col("payload").eqNullSafe(F.col("__last")))
    row = row.select((F.col("__top") + 1).alias("id"), F.lit(saved_at).alias("saved_at"), F.sha2(F.col("payload").cast("binary"), 256).alias("content_hash"), "payload")
    return revisions.unionByName(row)
