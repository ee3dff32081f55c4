"""Format registry and the Spark source: files -> ordered, hashed blocks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.functions import text as T
from textloom.functions.plain import Block, FormatError
from textloom.sources.lines import parse_img, parse_srt, parse_txt, render_img, render_srt, render_txt
from textloom.sources.markdown import parse_md, render_md
from textloom.sources.markup import parse_html, render_html
from textloom.sources.packages import parse_docx, parse_epub, render_docx, render_epub

#: File extensions and their formats.
EXTENSIONS = {
    ".txt": "txt", ".md": "md", ".markdown": "md", ".html": "html", ".htm": "html", ".docx": "docx", ".epub": "epub", ".srt": "srt",
    ".png": "img", ".jpg": "img", ".jpeg": "img", ".webp": "img", ".bmp": "img",
}
PARSERS: dict[str, Callable[..., list[Block]]] = {"txt": parse_txt, "md": parse_md, "html": parse_html, "docx": parse_docx, "epub": parse_epub, "srt": parse_srt, "img": parse_img}
RENDERERS: dict[str, Callable[..., bytes]] = {"txt": render_txt, "md": render_md, "html": render_html, "docx": render_docx, "epub": render_epub, "srt": render_srt, "img": render_img}

RUBY = "array<struct<token:string,base:string,rt:string,style:string>>"
BLOCK = f"seq int, src_text string, is_heading boolean, translatable boolean, kind string, para int, part int, slots map<string,string>, ruby {RUBY}, extra map<string,string>"


def detect_format(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    if ext not in EXTENSIONS:
        raise FormatError(f"no reader for {ext or 'files without extension'}")
    return EXTENSIONS[ext]


def format_of(path: Column) -> Column:
    """Format by extension, null where there is no reader."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)))


#: A block's value for each of its columns.
_VALUES: dict[str, Callable[[Block], object]] = {
    "seq": attrgetter("seq"), "src_text": attrgetter("text"), "is_heading": attrgetter("is_heading"), "translatable": attrgetter("translatable"), "kind": attrgetter("kind"), "para": attrgetter("para"),
    "part": attrgetter("part"), "slots": lambda b: list(b.slots.items()), "ruby": attrgetter("ruby"), "extra": lambda b: list(b.extra.items()),
}


def block_of(row: dict) -> Block:
    some = lambda x: dict(x) if x is not None else {}
    return Block(row["seq"], row["src_text"], row["translatable"], row["is_heading"], row["kind"], row["para"], row["part"], some(row["slots"]), [dict(e) for e in row["ruby"]] if row["ruby"] is not None else [], some(row["extra"]))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below a folder with a known extension, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").filter(format_of(F.col("path")).isNotNull())


#: Bytes that a Python task gathers before it passes them on; it gets four times as many at once, or one row: files have any size.
HELD = 1 << 20


def by_row(rows: DataFrame, one: Callable[..., Iterable[tuple[int, dict]]], schema: str | StructType) -> DataFrame:
    """``one(*row)`` of each row in Python gives (size, row) of what is made of it; a task holds one row as objects and what fits into ``HELD``, whatever the sizes of files and partitions."""
    kind, names = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for b in batches:
            for at in range(b.num_rows):
                for n, row in one(*(b.column(c)[at].as_py() for c in names)):
                    made.append(row)
                    size += n + 200
                    if size >= HELD:
                        yield pa.RecordBatch.from_pylist(made, schema=kind)
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=kind)

    bound, spark = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession
    now = spark.conf.get(bound).lower().rstrip("b")
    if not now.isdigit() or int(now) > 4 * HELD:
        spark.conf.set(bound, str(4 * HELD))
    return rows.mapInArrow(run, schema)


def parse_files(files: DataFrame, lang: str = "", loose: bool = False, backend: Callable | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Blocks of each file: (path, format, content_hash, error, seq, src_text, ..., src_hash), or those ``columns`` of them.

    A file that can't be read gives one row with ``error`` and no block; it never stops the others. Spark can't see which columns
    of a Python task are used, so who needs few of them says which: making all of a block's takes longer than parsing it.
    """

    full = StructType.fromDDL(f"path string, format string, content_hash string, error string, {BLOCK}")
    columns = [*full.names, "src_hash"] if columns is None else columns
    hashed = "src_hash" in columns
    schema = StructType([f for f in full if f.name in columns or f.name == "src_text" and hashed])
    values = [(c, of) for c, of in _VALUES.items() if c in schema.names]
    digested = "content_hash" in schema.names

    def parse(path: str, raw: bytes) -> list[dict]:
        head = {"path": path, "format": None, "content_hash": hashlib.sha256(raw).hexdigest() if digested else None, "error": None}
        try:
            head["format"] = detect_format(path)
            blocks = PARSERS[head["format"]](raw, lang=lang, loose=loose, backend=backend, path=path)
        except Exception as e:  # any bad file is a row, not a failed job
            return [head | {"error": f"{type(e).__name__}: {e}"}]
        return [head | {c: of(b) for c, of in values} for b in blocks] or [head]

    def one(path: str, raw: bytes | None) -> Iterator[tuple[int, dict]]:
        return ((len(row.get("src_text") or ""), row) for row in parse(path, raw or b""))

    out = by_row(files.select("path", "content"), one, schema)
    return (out.withColumn("src_hash", F.when(F.col("src_text").isNotNull(), T.src_hash(F.col("src_text")))) if hashed else out).select(*columns)


def folder_order(path: Column) -> Column:
    """Natural order of file names, as a folder import lists them."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return T.natural_key(stem)


def tags_of(c: Column) -> Column:
    """A JSON object of tags as a map; anything else is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def line_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of plain-text documents without readings, all in the JVM.

    (doc_id, seq, line, part, src_text, blank): a line is a paragraph, empty lines are fillers that
    take a seq, long lines are cut. Null texts have no lines. A document stays in its row until all its parts are
    numbered, so nothing is shuffled.
    """

    def cut(line: Column, number: Column) -> Column:
        blank = T.effectively_empty(line)
        parts = F.when(blank, F.array(line)).otherwise(T.split_long(line))
        return F.transform(parts, lambda p, k: F.struct(number.alias("line"), k.alias("part"), p.alias("src_text"), blank.alias("blank")))

    lines = F.split(T.without_last_newline(T.normalize_eol(F.col(text_col))), "\n", -1)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.flatten(F.transform(lines, cut))).alias("seq", "x"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "x.line", "x.part", "x.src_text", "x.blank")


def sequenced(lines: DataFrame) -> DataFrame:
    """Adds the hash."""
    return lines.select("doc_id", "seq", F.col("line").cast("long").alias("line"), F.col("part").cast("long").alias("part"), "src_text", (~F.col("blank")).alias("translatable"), T.src_hash(F.col("src_text")).alias("src_hash"))


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, src, cands, note) of a CSV or tab-separated glossary, in file order; later repeats are kept."""
    import csv
    import io

    raw = b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect())
    text = raw.decode("utf-8-sig", errors="replace")
    rows = list(csv.reader(io.StringIO(text))) if path.lower().endswith(".csv") else [x.split("\t") for x in text.splitlines()]
    out = []
    for i, row in enumerate(rows):
        if len(row) < 2 or not row[0].strip() or path.lower().endswith(".csv") and i == 0 and row[0].strip() in GLOSSARY_HEADER:
            continue
        cands = [c.strip() for c in row[1].split("|") if c.strip()][:3]
        if cands:
            out.append((len(out), row[0].strip(), cands, row[2].strip() if len(row) > 2 else ""))
    return spark.createDataFrame(out, "ord int, src string, cands array<string>, note string")


#: The header of a glossary file.
GLOSSARY_HEADER = ("源语言", "目标语", "注释")


def save_glossary(terms: DataFrame, path: str) -> None:
    """Write (ord, src, cands, note) as CSV with header and mark, or tab-separated; the file is replaced in one step."""
    import csv
    import io

    rows = [(r["src"], "|".join(r["cands"]), r["note"] or "") for r in terms.orderBy("ord").collect()]
    buf = io.StringIO()
    if path.lower().endswith(".csv"):
        writer = csv.writer(buf, lineterminator="\n")
        writer.writerow(GLOSSARY_HEADER)
        writer.writerows(rows)
        data = b"\xef\xbb\xbf" + buf.getvalue().encode()
    else:
        data = "".join("\t".join(r) + "\n" for r in rows).encode()
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)


def file_state(path: str) -> tuple[int, int] | None:
    """(modified, size) for noticing outside changes."""
    return (os.stat(path).st_mtime_ns, os.stat(path).st_size) if os.path.exists(path) else None


def payload(terms: DataFrame) -> DataFrame:
    """One row: the glossary as a JSON array in order."""
    item = F.struct("src", F.col("cands").alias("candidates"), "note")
    rows = F.array_sort(F.collect_list(F.struct("ord", item.alias("x"))))
    return terms.agg(F.to_json(F.transform(rows, lambda r: r["x"])).alias("payload"))


