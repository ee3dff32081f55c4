"""Output of documents: aligned translations, rendered files, text exports inside the JVM."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.plain import FormatError, restore, restore_ruby, strip_ruby
from textloom.operators.keep import keeper
from textloom.operators.skew import join_back
from textloom.operators.store import numbered
from textloom.sources.formats import PARSERS, RENDERERS
from textloom.sources.packages import new_docx, paragraph
from textloom.sources.sink import listed, write_files


def target_name(path: Column, fmt: Column, tgt_lang: str, output: str | None = None) -> Column:
    """stem.lang.ext; images become .md, another output format its own extension."""
    suffix = tgt_lang.partition("-")[0].lower() or "out"
    stem = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    own = F.when(fmt == "img", ".md").otherwise(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    ext = own if output is None else F.when(fmt != output, F.lit("." + output)).otherwise(own)
    return F.concat(stem, F.lit("." + suffix), ext)


def resolve(path: str, on_conflict: str = "overwrite", exists: Callable[[str], bool] = os.path.exists) -> str | None:
    """Where to write: overwrite, keep_both (name(2), name(3), ...) or skip (None)."""
    if not exists(path) or on_conflict == "overwrite":
        return path
    if on_conflict == "skip":
        return None
    stem, ext = os.path.splitext(path)
    n = 2
    while exists(f"{stem}({n}){ext}"):
        n += 1
    return f"{stem}({n}){ext}"


def existing_targets(targets: DataFrame, listing: DataFrame) -> DataFrame:
    return targets.join(listing.select("path"), "path", "left_semi").agg(F.count("*").alias("n"))


def aligned(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks with their target: the translation where there is one, else the source."""
    t = segments.select("doc_id", "seq", F.nullif("tgt_text", F.lit("")).alias("__t"))
    return lines.join(t, ["doc_id", "seq"], "left").withColumn("out_text", F.coalesce("__t", "src_text")).drop("__t")


def export_text(rows: DataFrame, mode: str = "target") -> DataFrame:
    """(doc_id, content) of plain-text documents from (doc_id, line, part, translatable, src_text, out_text), all in the JVM.

    The parts of a line are joined, then the lines; in bi_inter, each translated line follows its source and a blank line follows both.
    """
    if mode not in ("target", "bi_inter"):
        raise FormatError(f"txt has no mode {mode}")
    parts = rows.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("part", "src_text", "out_text"))).alias("p"), F.bool_or("translatable").alias("tr"))
    latin = T.mostly_latin(F.col("p")[0]["src_text"])
    texts = lambda f: F.transform("p", lambda x: x[f])
    whole = lambda f: F.when(F.col("tr"), T.join_parts(texts(f), latin)).otherwise(F.array_join(texts(f), ""))
    out = parts.select("doc_id", "line", "tr", whole("src_text").alias("s"), whole("out_text").alias("t"))
    body = F.col("t") if mode == "target" else F.when(F.col("tr"), F.concat("s", F.lit("\n"), "t", F.lit("\n"))).otherwise(F.col("t"))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("b")))), lambda x: x["b"]), "\n").alias("content"))


def export_table(rows: DataFrame) -> DataFrame:
    """(doc_id, content): a two-column Markdown table of source and target."""
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = F.concat(F.lit("| "), cell("src_text"), F.lit(" | "), cell("out_text"), F.lit(" |"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "part", line.alias("x")))), lambda x: x["x"])
    body = rows.filter("translatable").groupBy("doc_id").agg(F.array_join(listed, "\n").alias("b"))
    return body.select("doc_id", F.concat(F.lit("| 原文 | 译文 |\n|---|---|\n"), "b", F.lit("\n")).alias("content"))


def cross_format(blocks: list, done: dict[int, str], fmt: str) -> bytes:
    """Translatable blocks in another format, one paragraph each; slots are restored, heading marks removed."""
    out = []
    for b in blocks:
        if not b.translatable:
            continue
        text = restore_ruby(restore(done.get(b.seq, b.text), b.slots), [{**e, "style": "aozora"} for e in b.ruby])
        mark = re.match(r"#{1,6}", b.text)
        out.append((re.sub(r"#{1,6}\s*", "", text) if b.is_heading else text, len(mark[0]) if b.is_heading and mark else int(b.is_heading)))
    if fmt == "txt":
        return ("\n\n".join(t for t, _ in out) + "\n").encode()
    if fmt == "md":
        return ("\n\n".join(f"# {t}" if h else t for t, h in out) + "\n").encode()
    if fmt == "html":
        from html import escape

        body = "".join(f"<h{h}>{escape(t, quote=False)}</h{h}>" if h else f"<p>{escape(t, quote=False)}</p>" for t, h in out)
        return f"<html><body>{body}</body></html>".encode()
    if fmt == "docx":
        return new_docx([paragraph(t, min(h, 1)) for t, h in out])
    raise FormatError(f"no export to {fmt}")


def deal_names(wanted: DataFrame, existing: DataFrame, on_conflict: str = "overwrite") -> DataFrame:
    """(doc_id, name, note): under which name each document of ``wanted`` (doc_id, name) is written, null if it isn't, for names that exist or that several documents want.

    overwrite: the document with the largest id writes. skip: the one with the smallest, unless the name exists. keep_both: all write, the later ones as name(2), name(3), ...;
    numbers go on past files that exist and names that are wanted. Everything is settled before anything is written, so it doesn't depend on which task is
    faster. Places among equal names come from a range sort; documents of one name needn't meet in a task. ``existing``: (name).
    """
    if on_conflict not in ("overwrite", "skip", "keep_both"):
        raise ValueError(f"no rule {on_conflict} for names that exist")
    number = numbered(wanted.select("doc_id", "name"), ["name", "doc_id"], "__n")
    groups = number.groupBy("name").agg(F.min("__n").alias("__first"), F.max("__n").alias("__last"))
    known = existing.select("name").distinct().withColumn("__there", F.lit(True))
    groups = groups.join(known, "name", "left").withColumn("__there", F.coalesce("__there", F.lit(False)))
    if on_conflict == "keep_both":
        names = existing.select("name").unionByName(wanted.select("name")).distinct()
        taken = names.select(F.regexp_extract("name", _NUMBERED, 1).alias("a"), F.regexp_extract("name", _NUMBERED, 2).alias("k"), F.regexp_extract("name", _NUMBERED, 3).alias("z")).filter("k <> ''")
        taken = taken.groupBy(F.concat("a", "z").alias("name")).agg(F.array_sort(F.collect_set(F.try_to_number("k", F.lit("9" * 18)).cast("long"))).alias("__taken"))
        groups = groups.join(taken, "name", "left")
    out = join_back(number, groups, "name", spread=F.col("doc_id"))
    place, there = F.col("__n") - F.col("__first"), F.col("__there")
    if on_conflict == "overwrite":
        last = F.col("__n") == F.col("__last")
        return out.select("doc_id", F.when(last, F.col("name")).alias("name"), F.when(~last, F.lit("overwritten by a later document of this name")).alias("note"))
    if on_conflict == "skip":
        goes = ~there & (place == 0)
        return out.select("doc_id", F.when(goes, F.col("name")).alias("name"), F.when(~goes, F.lit("skipped: the file exists")).alias("note"))
    # the first free number for the first one that has to move, the next for the next: each taken number below shifts it by one
    rank = place + F.when(there, 2).otherwise(1)
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), rank.cast("long"), lambda n, t: n + F.when(t.between(2, n), 1).otherwise(0))
    moved = F.concat(F.regexp_extract("name", _PARTS, 1), F.lit("("), free.cast("string"), F.lit(")"), F.regexp_extract("name", _PARTS, 2))
    stays = ~there & (place == 0)
    return out.select("doc_id", F.when(stays, F.col("name")).otherwise(moved).alias("name"), F.when(~stays, F.lit("the file exists; written under another name")).alias("note"))


#: A name with a number, and a name's stem and extension.
_NUMBERED, _PARTS = r"(?s)^(.*)\(([1-9][0-9]{0,17})\)((?:\.[^.]*)?)$", r"(?s)^(.+?)((?:\.[^.]*)?)$"


def export_files(files: DataFrame, docs: DataFrame, segments: DataFrame, out_dir: str, tgt_lang: str, lang: str = "", loose: bool = False, mode: str = "target", output: str | None = None, on_conflict: str = "overwrite", policy: str = "keep", force: bool = False, backend=None) -> DataFrame:
    """Write a translated file per document; returns (doc_id, ok, out_path, warnings).

    ``files`` (path, content) are parsed again with the options of the import and aligned by seq. A document whose bytes have changed is
    refused unless ``force``; open segments are a warning; a failing document doesn't stop the others. Names are dealt out first (``deal_names``) to the documents
    that could be rendered, against a listing of ``out_dir``, which is any folder that Spark and pyarrow reach; then the files are written by tasks and moved to their names (``sink``).
    """
    t = segments.filter("translatable").groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("tgt_text") != "", F.struct("seq", "tgt_text", "ruby_map"))).alias("done"), F.count_if(F.col("status").isin("pending", "failed")).alias("open")
    )
    rows = docs.select(F.col("id").alias("doc_id"), "path", "format", "content_hash", "tags").join(t, "doc_id", "left").join(files, "path", "left").withColumn("name", target_name(F.col("path"), F.col("format"), tgt_lang, output))

    def run(batches):
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                notes = [f"{int(r.open)} segments have no translation"] if r.open and r.open == r.open else []
                try:
                    if r.content is None:
                        raise FormatError("the source is missing")
                    raw = bytes(r.content)
                    if hashlib.sha256(raw).hexdigest() != r.content_hash:
                        if not force:
                            raise FormatError("the source has changed since its import")
                        notes.append("the source has changed since its import")
                    blocks = PARSERS[r.format](raw, lang=lang, loose=loose, backend=backend, path=r.path)
                    own = (dict(r.tags) if r.tags is not None else {}).get("ruby_policy") or policy
                    done = {int(x["seq"]): strip_ruby(x["tgt_text"]) if own == "drop" else x["tgt_text"] for x in (r.done if r.done is not None else [])}
                    readings = {int(x["seq"]): dict(x["ruby_map"]) for x in (r.done if r.done is not None else []) if x["ruby_map"] is not None and own == "translate"}
                    data = cross_format(blocks, done, output) if output and output != r.format else RENDERERS[r.format](raw, blocks, done, mode=mode, readings=readings, lang=lang)
                    made.append((r.doc_id, r.name, data, notes))
                except Exception as e:
                    made.append((r.doc_id, None, None, [*notes, str(e)]))
            yield pd.DataFrame(made, columns=["doc_id", "wanted", "content", "warnings"])

    keep = keeper(rows.sparkSession)
    made = keep(rows.mapInPandas(run, "doc_id long, wanted string, content binary, warnings array<string>"), "rendered")
    names = deal_names(made.filter("content is not null").select("doc_id", F.col("wanted").alias("name")), listed(rows.sparkSession, out_dir), on_conflict)
    names = keep(names, "names")
    write_files(made.select("doc_id", "content").join(names.filter("name is not null"), "doc_id"), out_dir)
    out = made.drop("content", "wanted").join(names, "doc_id", "left")
    notes = F.when(F.col("note").isNull(), F.col("warnings")).otherwise(F.array_append("warnings", F.col("note")))
    return out.select("doc_id", F.col("name").isNotNull().alias("ok"), F.concat(F.lit(out_dir.rstrip("/") + "/"), F.col("name")).alias("out_path"), notes.alias("warnings"))
