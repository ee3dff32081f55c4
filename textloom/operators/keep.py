"""Writing intermediate tables of a run to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of an execution go as it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keeper(spark: SparkSession) -> Callable[..., DataFrame]:
    """``keep(df, name, *by)``: write as Parquet, in folders by the last columns if they are named, below ``spark.checkpoint.dir`` and read back; a local session without it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
    home = f"{root.rstrip('/')}/runs/{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{home}/{name}"
        with releasing(spark):
            df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind: a table that was written is read from then on, not its shuffles."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def drop(*kept: DataFrame) -> None:
    """Remove tables that ``keep`` wrote, once nothing reads them any more; other tables stay."""
    for df in kept:
        spark = df.sparkSession
        for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/runs/[0-9a-f]{32}/[^/]+(?=/)", f))}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
