"""Joins of many rows to one result a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task of the join may get; with more rows in all, a five-hundredth of them.
SHARE, PARTS = 100_000, 500


def crowded(rows: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """(key, shares) of the keys with more rows than a share, and how many tasks these are worth: ``PARTS`` keys at most.

    Counts are combined before the shuffle, so a key costs a row a task.
    """
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return largest(counts, share)


def largest(counts: DataFrame, share: int | None = None) -> DataFrame:
    """The same from counts (__key, __n) that are known."""
    top = counts.filter(F.col("__n") > (SHARE if share is None else share)).orderBy(F.desc("__n"), "__key").limit(PARTS)
    return top.select("__key", F.ceil(F.col("__n") / (SHARE if share is None else share)).cast("long").alias("__shares"))


def join_back(rows: DataFrame, results: DataFrame, key: str, spread: Column, share: int | None = None, heavy: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """Left join of ``rows`` to ``results`` (at most one a key, no other common columns) in which no key meets in one task.

    The rows of a crowded key choose one of its shares by the hash of ``spread``, and its result is entered once a share; all other keys have
    one. Only the names of crowded keys are sent to all tasks, so results may be of any size. Null keys, and rows without ``condition``, match nothing; they
    are dealt over all tasks. ``heavy``: crowded keys, if they are known already.
    """
    heavy = crowded(rows.filter(F.col(key).isNotNull() & (F.lit(True) if condition is None else condition)), key, share) if heavy is None else heavy
    takes_part = F.col(key).isNotNull() if condition is None else F.col(key).isNotNull() & condition
    at = F.pmod(F.xxhash64(spread), F.coalesce("__shares", F.lit(1)))
    left = rows.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left").withColumn("__share", F.when(takes_part, at).otherwise(-1 - F.pmod(F.xxhash64(spread), F.lit(1 << 20)))).drop("__key", "__shares")
    right = results.withColumnRenamed(key, "__result").join(F.broadcast(heavy), F.col("__result") == F.col("__key"), "left")
    right = right.withColumn("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__shares", F.lit(1)) - 1))).drop("__key", "__shares")
    out = left.join(right, (F.col(key) == F.col("__result")) & (F.col("__share") == F.col("__of")), "left")
    return out.drop("__share", "__of", "__result")
