"""A log of changes that can be undone, over any number of operations.

The log has a row for each segment that an operation changed: (op, label, seg_id, before, status_before), what it was before that operation.
What a segment was as of a version is what its earliest later change has as ``before``; so going back over many operations is one aggregate, a minimum that combines
before the shuffle, and one join. Operations are undone from the newest on, as on a stack. An undo puts back what the log says, whatever was
done to the segment outside of it since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.keep import keeper

LOG = "op long, label string, seg_id long, before string, status_before string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def push(log: DataFrame, changes: DataFrame, label: str) -> DataFrame:
    """The log with one more operation, ``changes`` (seg_id, before, status_before), written; without changes there is none.

    Where an operation changed a segment more than once, ``ord`` says in which order, and the first counts.
    """
    spark = log.sparkSession
    order = F.col("ord") if "ord" in changes.columns else F.lit(0)
    once = changes.groupBy("seg_id").agg(F.min_by(F.struct("before", "status_before"), order).alias("x"))
    number = newest(log) + 1
    added = keeper(spark)(once.select(F.lit(number).cast("long").alias("op"), F.lit(label).alias("label"), "seg_id", "x.before", "x.status_before"), "changes")
    return log.unionByName(added)


def newest(log: DataFrame) -> int:
    """The number of the newest operation, 0 if there is none."""
    return log.agg(F.coalesce(F.max("op"), F.lit(0))).first()[0]


def operations(log: DataFrame) -> DataFrame:
    """(op, label, segments) from the newest on: what can be undone."""
    return log.groupBy("op").agg(F.first("label").alias("label"), F.count("*").alias("segments")).orderBy(F.desc("op"))


def as_of(segments: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """Texts and states after operation ``version`` (0: before all of them)."""
    then = log.filter(F.col("op") > version).groupBy(F.col("seg_id").alias("__id")).agg(F.min_by(F.struct("before", "status_before"), "op").alias("__x"))
    out = segments.join(then, F.col("id") == F.col("__id"), "left")
    changed = F.col("__id").isNotNull()
    new = {"tgt_text": F.when(changed, F.col("__x.before")).otherwise(F.col("tgt_text")), "status": F.when(changed, F.col("__x.status_before")).otherwise(F.col("status"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in segments.columns])


def undo_last(segments: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, log) without the newest operation; both unchanged if there is none."""
    top = newest(log)
    return (as_of(segments, log, top - 1), log.filter(F.col("op") < top)) if top else (segments, log)
