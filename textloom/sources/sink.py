"""Files of documents as a sink of Spark: ``df.write.format("document_files")`` with rows (name, content).

Tasks write below a folder of the write's own, through the file system that the path names (``pyarrow.fs``: a shared folder, an object store,
HDFS). The driver moves the files of the tasks that were committed to their names; what failed or repeated tasks have left goes with the folder. Names
are settled before (``export.deal_names``), so no task looks at what is there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "document_files"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.folder = path, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = place(self.path)
        system.create_dir(f"{root}/{self.folder}", recursive=True)
        files = []
        for row in iterator:
            temporary = f"{root}/{self.folder}/{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(bytes(row["content"]))
            files.append((temporary, row["name"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        for message in messages:
            for temporary, name in message.files if message else []:
                system.move(temporary, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.folder}").type is not fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.folder}")


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DocumentFilesWriter:
        return DocumentFilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Write (name, content) as files below ``path``; files of those names are replaced."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("name", "content").write.format(FORMAT).mode("append").save(path)


def listed(spark, path: str) -> DataFrame:
    """(name) of the files in the folder, none if there is no folder; their contents aren't read."""
    from pyspark.sql import functions as F

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.listStatus(where):
        return spark.createDataFrame([], "name string")
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
