"""Totals of runs, tags, and language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.store import RUNS, numbered, update

#: Language codes and their Chinese names.
LANGUAGES = {
    "zh-CN": "中文-中国（简体）", "zh-TW": "中文-台湾（繁体）", "zh-HK": "中文-香港（繁体）", "en-US": "英语-美国", "en-GB": "英语-英国", "ja-JP": "日语-日本",
    "ko-KR": "韩语-韩国", "fr-FR": "法语-法国", "de-DE": "德语-德国", "es-ES": "西班牙语-西班牙", "pt-BR": "葡萄牙语-巴西", "it-IT": "意大利语-意大利",
    "ru-RU": "俄语-俄罗斯", "uk-UA": "乌克兰语-乌克兰", "ar-SA": "阿拉伯语-沙特阿拉伯", "th-TH": "泰语-泰国", "vi-VN": "越南语-越南", "id-ID": "印尼语-印度尼西亚",
    "tr-TR": "土耳其语-土耳其", "pl-PL": "波兰语-波兰", "nl-NL": "荷兰语-荷兰",
}
#: Recognition models by language.
RECOGNITION = {"zh": "ch", "ja": "japan", "jp": "japan", "en": "en", "ko": "korean", "kr": "korean"}


def language_label(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = F.try_element_at(names, code)
    return F.when(F.coalesce(code, F.lit("")) == "", "").when(name.isNull(), code).otherwise(F.concat(code, F.lit("（"), name, F.lit("）")))


def recognition_model(code: Column) -> Column:
    models = F.create_map(*[F.lit(x) for kv in RECOGNITION.items() for x in kv])
    return F.coalesce(F.try_element_at(models, F.substring_index(F.lower(F.coalesce(code, F.lit(""))), "-", 1)), F.lit("ch"))


def is_local_url(url: Column) -> Column:
    """Loopback, private address or a .local name."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1), F.lit("")))
    private = r"^(?:localhost|.*\.local|0\.0\.0\.0|\[::1\]|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+)$"
    return host.rlike(private)


def provider_type(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.contains(low, F.lit("anthropic")), "anthropic").when(F.contains(low, F.lit("generativelanguage")) | F.contains(low, F.lit("gemini")), "gemini").otherwise("openai")


def run_totals(items: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """Per run_id: total, done, failed, tokens and cost from item rows (run_id, status, tokens_in, tokens_out)."""
    out = items.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
    return out.withColumn("cost", T.run_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def create_run(runs: DataFrame, kind: str, total: int, now: float) -> tuple[DataFrame, int]:
    """(runs with one more, its id): it is running, with nothing done; ids go on from the largest."""
    number = runs.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    row = [(number, kind, "running", total, 0, 0, 0, 0, 0.0, "", now, None)]
    return runs.unionByName(runs.sparkSession.createDataFrame(row, RUNS)), number


def finish_run(runs: DataFrame, number: int, totals: DataFrame, now: float, error: str = "") -> DataFrame:
    """The run with what it came to (``totals``: status, done, failed, tokens_in, tokens_out, cost); one that is to go on isn't finished."""
    change = totals.select(
        F.lit(number).cast("long").alias("id"), "status", "done", "failed", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), "cost",
        F.lit(error).alias("error"), F.when(F.col("status") == "completed", F.lit(now)).alias("finished_at"),
    )
    return update(runs, change, "id")


def run_items(results: DataFrame, number: int, first_id: int = 1) -> DataFrame:
    """(id, run_id, segment_id, status, retries, error): what became of each segment of a run; what has no answer yet is pending."""
    state = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "pending", "pending").otherwise("done")
    items = results.select(F.lit(number).cast("long").alias("run_id"), F.col("id").alias("segment_id"), state.alias("status"), (F.coalesce("retries", F.lit(0)) if "retries" in results.columns else F.lit(0)).cast("long").alias("retries"), F.when(F.col("status") == "failed", F.col("cause")).otherwise("").alias("error"))
    return numbered(items, ["segment_id"], "__n").select((F.col("__n") + first_id - 1).alias("id"), "run_id", "segment_id", "status", "retries", "error")


def latest(df: DataFrame, n: int = 1, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def union_tags(docs: DataFrame) -> DataFrame:
    """(key, value) over all documents: of non-empty values, the one of the last document (by id) counts."""
    rows = docs.select("id", F.explode("tags").alias("key", "value")).filter("value <> ''")
    return rows.groupBy("key").agg(F.max_by("value", "id").alias("value"))


def fresh_models(cache: DataFrame, now: float, ttl: float = 86400.0, keep: int = 50) -> DataFrame:
    """Cached model lists (provider, saved_at, models) that aren't older than ``ttl``, the newest ``keep``."""
    out = cache.orderBy(F.desc("saved_at"), "provider").limit(keep).filter(F.lit(now) - F.col("saved_at") < ttl)
    return out.withColumn("models", F.array_sort(F.array_distinct("models")))
