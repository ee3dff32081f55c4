"""What a run has asked a model, and what came back: an append-only table, so that a run can be stopped and taken up again.

A ledger is a folder on a file system that all executors share. Requests are asked in micro-batches; each is appended by one write, which
Spark commits as a whole, so what was answered before a run was cut off is there when it goes on, and only the others are asked. A
micro-batch that is cut off itself leaves nothing and is asked again. Between micro-batches the run looks at a flag, and stops if it is set, or
if an answer says that asking on is useless (no authorisation, no balance).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.keep import keeper, releasing

ANSWER = "struct<id:long,t:string,ruby:map<string,string>>"
ENTRIES = f"stage string, req string, key string, answers array<{ANSWER}>, tokens_in long, tokens_out long, attempts int, error string"
#: The error of a request that wasn't asked, because the run was stopped.
STOPPED = "Stopped"
#: Micro-batches of one call, at most: each costs some jobs, so their number doesn't grow with the input. What is cut off loses one of them.
MOST = 16
#: Folder of a request.
BUCKET = "bucket"


@dataclass(frozen=True)
class Ledger:
    """The entries of one run below ``path``; ``size``: requests of a micro-batch, more where there would be over ``MOST`` micro-batches."""

    path: str
    size: int = 1000

    def entries(self, spark: SparkSession) -> DataFrame:
        """All entries so far, none if there is no such folder yet."""
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], ENTRIES)
        return spark.read.schema(ENTRIES).parquet(self.path)

    def ask(self, requests: DataFrame, stage: str, ask: Callable[[DataFrame], DataFrame], final: list[str], stop: Callable[[], bool]) -> DataFrame:
        """All ``requests`` (req, ids, system, user, ...) without their prompts, with answers, tokens_in, tokens_out and error from the ledger or the model.

        ``ask`` answers a table of requests (req, key, ids, system, user), handing on the key and adding ``attempts``; errors in ``final`` are no answers, so such
        requests stay open and the run stops. A request counts as answered only with the same text: what changed since is asked again. ``stage`` tells requests
        of one name apart. Requests that were written ``in_buckets`` already aren't written again.
        """
        spark = requests.sparkSession
        if BUCKET not in requests.columns:
            requests = keeper(spark)(in_buckets(requests), "open", BUCKET)
        known = self.answered(spark, stage, final)
        some_known = not known.isEmpty()
        unknown = lambda part: part.join(known, ["req", "key"], "left_anti") if some_known else part
        chunks = min(-(-unknown(requests.select("req", "key")).count() // self.size), MOST)
        useless = lambda: self.entries(spark).filter((F.col("stage") == stage) & F.col("error").isin(final)).count()
        before = useless()
        for i in range(chunks):
            if stop():
                break
            part = unknown(requests.filter(F.col(BUCKET) % chunks == i).select("req", "key", "ids", "system", "user"))  # a micro-batch reads its own folders
            done = ask(part).select(F.lit(stage).alias("stage"), "req", "key", "answers", "tokens_in", "tokens_out", "attempts", "error")
            with releasing(spark):
                done.write.mode("append").parquet(self.path)
            if useless() > before:
                break
        asked = self.entries(spark).filter(F.col("stage") == stage)
        newest = asked.groupBy("req", "key").agg(F.max_by(F.struct("answers", "error"), F.when(F.coalesce(F.col("error").isin(final), F.lit(False)), 0).otherwise(1)).alias("a"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
        rest = requests.drop("system", "user", BUCKET)
        out = rest.join(newest, ["req", "key"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        error = F.when(F.col("a").isNull(), STOPPED).otherwise(F.col("a.error"))
        more = [F.coalesce("a.answers", F.array().cast(f"array<{ANSWER}>")).alias("answers"), zero("i").alias("tokens_in"), zero("o").alias("tokens_out"), error.alias("error")]
        return out.select(*[c for c in rest.columns if c != "key"], *more)

    def answered(self, spark: SparkSession, stage: str, final: list[str]) -> DataFrame:
        """(req, key) of what needn't be asked any more."""
        done = ~F.coalesce(F.col("error").isin(final), F.lit(False))
        return self.entries(spark).filter((F.col("stage") == stage) & done).select("req", "key").distinct()


def in_buckets(requests: DataFrame) -> DataFrame:
    """Adds ``key``, a hash of the prompts, and the folder to write a request to; a micro-batch is some of the folders, so requests are written once."""
    return requests.withColumn("key", F.sha2(F.concat_ws("\x1f", "system", "user"), 256)).withColumn(BUCKET, F.pmod(F.xxhash64("req"), F.lit(MOST)).cast("int"))
