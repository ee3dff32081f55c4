"""Shared pieces of the training-data operators.

* ``stage`` cuts lineage: it writes a table into the folder that the session names in
  ``spark.checkpoint.dir`` (shared by all executors) and reads it back.
* ``lean`` bounds the Arrow batches that Python tasks get by bytes, not by rows alone.
* ``attach`` joins rows to one-row-per-key group results without a hot key in one task.
* ``bits_of``, ``has_bit`` and ``test_bits`` build and probe a bitmap of fixed size.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every contract of this package: a maximal run without ASCII white space.
WORD = "[^\x20\x09-\x0d]+"

#: Groups that ``attach`` broadcasts at most.
HEAVY = 1000

#: log2 of the bits of a bitmap: 2**24 bits are 512 rows of 4 KiB, 2 MiB in all.
BITMAP_LOG2 = 24

#: Bytes of an Arrow batch: rows hold whole texts, so a bound on rows alone bounds nothing.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of this machine is taken for a ``local`` master (tests); a
    cluster without the setting is an error, as its machines share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def lean(df: DataFrame) -> DataFrame:
    """``df``, whose Arrow batches (either way) get ``BATCH_BYTES`` at most, or one row; a lower setting of the session stays."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them must be staged itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, spread: Column, heavy: int = HEAVY) -> DataFrame:
    """Left join ``rows`` to ``groups`` (one row a key; ``size`` is its row count).

    The ``heavy`` largest groups are broadcast, and so is the group of the null key, if there is one: at most
    ``heavy`` + 1 rows, whatever the input; the caller keeps the payload of a row small. Any
    other group holds fewer than 1/heavy of the rows, so the shuffled join of the rest is even;
    rows already matched, and those with a null key, are dealt by ``spread`` there. Null keys match null keys. ``groups``
    should be a staged table, since it is read twice.
    """
    payload = [c for c in groups.columns if c not in key]
    null = lambda df: reduce(and_, [df[c].isNull() for c in key])
    top = groups.orderBy(F.desc(null(groups)), F.desc(size), *key).limit(heavy + 1)
    top = top.select(*[F.col(c).alias(f"__hk_{c}") for c in key], *[F.col(c).alias(f"__hp_{c}") for c in payload], F.lit(True).alias("__hot"))
    on_top = [F.col(c).eqNullSafe(F.col(f"__hk_{c}")) for c in key]
    out = rows.withColumn("__null", null(rows)).join(F.broadcast(top), on_top, "left")
    dealt = F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(1 << 20))
    out = out.withColumn("__salt", F.when(F.col("__hot") | F.col("__null"), dealt).otherwise(F.lit(0)).cast("long"))
    rest = groups.select(*[F.col(c).alias(f"__rk_{c}") for c in key], *[F.col(c).alias(f"__rp_{c}") for c in payload], F.lit(0).cast("long").alias("__rsalt"))
    on_rest = [F.col(c).eqNullSafe(F.col(f"__rk_{c}")) for c in key] + [F.col("__salt") == F.col("__rsalt")]
    out = out.join(rest, on_rest, "left")
    return out.select(*rows.columns, *[F.when(F.col("__hot"), F.col(f"__hp_{c}")).otherwise(F.col(f"__rp_{c}")).alias(c) for c in payload])


def bitmap_log2(rows: int) -> int:
    """Bits for so many keys: eight for each, 2**24 (2 MiB) at least and 2**29 (64 MiB) at most."""
    return min(29, max(BITMAP_LOG2, (8 * max(rows, 1) - 1).bit_length()))


def _slot(key: Column, log2: int = BITMAP_LOG2) -> Column:
    return F.pmod(key, F.lit(1 << log2)).cast("long") + 1


def bits_of(keys: DataFrame, key: str, log2: int = BITMAP_LOG2) -> DataFrame:
    """A bitmap (bucket, bits) of the values of the long column ``key``: 2**log2 bits in rows of 4 KiB at most."""
    slots = keys.select(_slot(F.col(key), log2).alias("x"))
    return slots.groupBy(F.bitmap_bucket_number("x").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits"))


def repeated_bits(keys: DataFrame, key: str, log2: int = BITMAP_LOG2) -> DataFrame:
    """The bitmap of the values that occur twice or more."""
    return bits_of(keys.groupBy(key).count().filter("count > 1"), key, log2)


def bitmap_bytes(bitmap: DataFrame, log2: int) -> np.ndarray:
    """The bitmap as one array of 2**log2 bits, for Python tasks; its size doesn't depend on the data."""
    out = np.zeros((1 << log2) // 8, dtype=np.uint8)
    for bucket, bits in bitmap.collect():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def test_bits(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    """Which of the unsigned 64-bit ``keys`` have their bit set (the slot is the key modulo 2**log2)."""
    at = keys & np.uint64((1 << log2) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def has_bit(rows: DataFrame, bitmap: DataFrame, key: str, flag: str, log2: int = BITMAP_LOG2) -> DataFrame:
    """Add the boolean ``flag``: whether ``key``'s slot is set. The bitmap has 2**(log2 - 15) rows of 4 KiB at most, so it is broadcast."""
    slot = _slot(F.col(key), log2)
    out = rows.withColumn("__at", F.bitmap_bit_position(slot)).join(F.broadcast(bitmap), F.bitmap_bucket_number(slot) == F.col("__bucket"), "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1")
    return out.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("__at", "__bucket", "__bits")
