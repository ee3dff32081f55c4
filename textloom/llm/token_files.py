"""Token-id output: flat unsigned integer files with 64-bit document offsets.

``write_tokens`` orders documents by id (range partitioning, so no task holds all), and every task
streams its partition, batch by batch, to three files in the shared folder:

* ``<n>.bin``: ids, unsigned 16 bit little-endian if the vocabulary fits, else 32 bit;
* ``<n>.idx``: document offsets in tokens, 64-bit little-endian, one more than documents;
* ``<n>.doc``: document ids, 64-bit little-endian (the least integer stands for null).

Files appear by an atomic rename, so a task that runs twice leaves the same files. A prefix sum
over the partitions' token counts gives each partition its base; it is kept in ``manifest.json``.
``read_tokens`` maps the files into memory and yields a row per document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fresh_path, lean, table
from textloom.llm.tokens import encoder, tokenizer_path

NULL_ID = -(2**63)
KINDS = ("bin", "idx", "doc")


def _fs(root: str):
    return pafs.FileSystem.from_uri(root)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write ``docs`` under ``out``; returns the manifest {dtype, parts: [[n, documents, tokens, base]]}.

    Documents come in ascending id order; equal ids by text hash; null ids first. A null text counts as empty
    (the end id alone). Other columns are ignored; an empty input writes a manifest without parts.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(encoder(path).vocab_size - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = _fs(out)
        fs.create_dir(base, recursive=True)
        name, tmp = f"{base}/{ctx.partitionId():08d}", f"{base}/.{ctx.partitionId():08d}-{ctx.taskAttemptId()}"
        enc, end, docs_done, at = encoder(path), int(end_id).to_bytes(4, "little"), 0, 0
        with ExitStack() as files:
            bin_, idx, doc = (files.enter_context(fs.open_output_stream(f"{tmp}.{kind}")) for kind in KINDS)
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                ends = np.empty(len(batch), "<i8")
                for i, text in enumerate(batch.column("text")):  # one text at a time becomes a Python string
                    tokens = np.frombuffer(enc.encode_bytes(text.as_py()) + end, dtype="<u4")
                    bin_.write(tokens.astype(dtype).tobytes())
                    at += len(tokens)
                    ends[i] = at
                idx.write(ends.tobytes())
                doc.write(pc.fill_null(batch.column("doc_id"), NULL_ID).to_numpy().astype("<i8").tobytes())
                docs_done += len(batch)
        for kind in KINDS:
            fs.move(f"{tmp}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "docs": [docs_done], "tokens": [at]})

    counts = lean(rows).mapInArrow(write, "part long, docs long, tokens long").filter("docs > 0").collect()  # a row per partition
    counts = sorted(tuple(r) for r in counts)
    bases = np.cumsum([0, *(t for _, _, t in counts)]).tolist()
    manifest = {"dtype": dtype, "parts": [[p, d, t, b] for (p, d, t), b in zip(counts, bases)]}
    fs, base = _fs(out)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def map_file(out: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where the folder is a mounted one, else read."""
    fs, base = _fs(out)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype=dtype, mode="r") if fs.get_file_info(f"{base}/{name}").size else np.empty(0, dtype)
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_tokens(spark: SparkSession, out: str, each: Callable[[np.ndarray], dict], schema: str, step: int = 2000) -> DataFrame:
    """A row per document from the files: (doc_id, start, n_tokens, *each(ids)); ``each`` sees a document's mapped ids."""
    fs, base = _fs(out)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]
    parts = [(p, b) for p, _, _, b in manifest["parts"]]
    todo = spark.createDataFrame(parts, "part long, base long")
    todo = todo.repartition(max(1, len(parts)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, first in zip(pdf["part"], pdf["base"]):
                tokens, ends, ids = (map_file(out, f"{part:08d}.{k}", t) for k, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for at in range(0, len(ids), step):
                    some = range(at, min(at + step, len(ids)))
                    made = pd.DataFrame([each(tokens[ends[i] : ends[i + 1]]) for i in some])
                    doc_ids = pd.array(ids[some.start : some.stop], dtype="Int64")
                    doc_ids[np.asarray(ids[some.start : some.stop]) == NULL_ID] = pd.NA
                    head = pd.DataFrame({"doc_id": doc_ids, "start": first + ends[some.start : some.stop], "n_tokens": np.diff(ends[some.start : some.stop + 1])})
                    yield pd.concat([head, made], axis=1)

    return todo.mapInPandas(read, f"doc_id long, start long, n_tokens long, {schema}")


def crc_of(tokens: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(tokens.astype("<u4").tobytes())}


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), out)
    return read_tokens(spark, out, crc_of, "ids_crc32 long")
