"""Secret scans with an incremental ledger of blobs (native).

Every version of every path is addressed by the SHA-256 of its content. The ledger says which rule
versions a blob has been scanned with and what they found; only unseen pairs are scanned, once per
blob however many paths hold it, and the findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import HEAVY, bitmap_log2, bits_of, fresh_path, has_bit, stage, table


@dataclass(frozen=True)
class Rule:
    """``kind`` and ``version`` name the pair; a match counts if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. For access and hex, the least length stands in the pattern: such runs are maximal, so it finds the same.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds of credentials in public formats.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chatbot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
#: Paths of one blob that are joined to its findings in one task, on average.
SHARE = 1000
SPANS = "array<struct<start:long,ord:int,kind:string,end:long,rule:string>>"


def running_sums(numbers: Column) -> Column:
    """Prefix sums of an array of longs by doubling: in each step, every place adds what stands 1, 2, 4, ... places before it."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1.0)).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def add(sums: Column, by: Column) -> Column:
        moved = F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), by), sums), F.lit(1), F.size(sums))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    return F.aggregate(steps, numbers, add)


def find_spans(text: Column, rule: Rule, order: int) -> Column:
    """All leftmost non-overlapping matches in code points, as an array of (start, ord, kind, end, rule).

    The text between matches and the matches themselves alternate, so matches end at the running sums of their lengths.
    """
    pattern = F.lit(rule.pattern)
    gaps, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    sizes = lambda x: F.transform(x, lambda s: F.length(s).cast("long"))
    found = F.struct(sizes(gaps).alias("gap"), sizes(whole).alias("whole"), sizes(checked).alias("checked"))

    def placed(x: Column) -> Column:
        n = F.size(x["whole"])
        ends = running_sums(F.zip_with(F.slice(x["gap"], F.lit(1), n), x["whole"], lambda a, b: a + b))
        each = F.filter(F.arrays_zip(ends.alias("end"), x["whole"].alias("size"), x["checked"].alias("checked")), lambda p: p["checked"] >= rule.least)
        return F.transform(each, lambda p: F.struct((p["end"] - p["size"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), p["end"].alias("end"), F.lit(rule.name).alias("rule")))

    once = F.element_at(F.transform(F.array(found), placed), 1)  # an array of one binds what was found, so that no pattern is run again
    return F.when(F.rlike(text, pattern), once).otherwise(F.array().cast(SPANS))


def scan(paths: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, blob, spans), spans by start, then by the order of ``rules``.

    ``ledger``: folder of the ledger, a Parquet table (blob, scanned, found); a first scan creates it, later scans
    append what they find. Entries that two scans made of one blob at the same time count once. Without it, a new one is made. Null texts count as empty. Repeated rows
    are reported as often as they occur; other columns are ignored; an empty input gives no rows.

    One text per unseen blob is scanned: a bitmap of the unseen blobs sorts out the rest where the texts are, and copies
    combine before the shuffle. Findings are joined back by blob; only blobs with findings take part, and what is broadcast
    of the most frequent of these is a hash and a count.
    """
    spark = paths.sparkSession
    ledger = ledger or fresh_path(spark, "secret-ledger")
    names = [r.name for r in rules]
    base = paths.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.withColumn("__blob", F.sha2(F.col("__text").cast("binary"), 256))
    keys = stage(base.select("__id", "__blob", F.xxhash64(F.monotonically_increasing_id()).alias("__row")), "secret-keys")
    blobs = stage(keys.groupBy("__blob").agg(F.count("*").alias("__n")), "secret-blobs")
    known, texts = _ledger(spark, ledger), base
    every = F.lit(names).cast("array<string>")
    if known is None:
        texts = base.groupBy("__blob").agg(F.first("__text").alias("__text")).withColumn("__todo", every)
    else:
        seen = known.groupBy("__blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("__seen"))
        todo = blobs.join(seen, "__blob", "left").select("__blob", F.array_except(every, F.coalesce("__seen", F.array().cast("array<string>"))).alias("__todo"))
        todo = stage(todo.filter(F.size("__todo") > 0), "secret-todo")
        log2 = bitmap_log2(todo.count())
        bits = stage(bits_of(todo.select(F.xxhash64("__blob").alias("__key")), "__key", log2), "secret-bits")
        texts = has_bit(base.withColumn("__key", F.xxhash64("__blob")), bits, "__key", "__unseen", log2).filter("__unseen")
        texts = texts.groupBy("__blob").agg(F.first("__text").alias("__text")).join(todo, "__blob")
    none = F.array().cast(SPANS)
    found = F.concat(*[F.when(F.array_contains("__todo", r.name), find_spans(F.col("__text"), r, k)).otherwise(none) for k, r in enumerate(rules)])
    texts.select("__blob", F.col("__todo").alias("scanned"), found.alias("found")).write.mode("append").parquet(ledger)
    now = _ledger(spark, ledger)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    groups = now.select("__blob", F.filter("found", lambda s: s["rule"].isin(names)).alias("found")).filter(F.size("found") > 0).groupBy("__blob").agg(spans.alias("spans"))
    groups = stage(blobs.join(groups, "__blob").select("__blob", "__n", "spans"), "secret-groups")
    return _spread(keys, groups).select(F.col("__id").alias(id_col), F.col("__blob").alias("blob"), F.coalesce("spans", none).alias("spans"))


def _spread(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``keys`` with the spans of their blobs. A blob of many paths is entered ``ceil(n / SHARE)`` times, and its paths choose one of these by their number.

    So no task holds more than some ``SHARE`` paths of one blob, and what is broadcast of a crowded blob is a hash and a count.
    """
    crowded = groups.orderBy(F.desc("__n"), "__blob").limit(HEAVY).filter(F.col("__n") > SHARE)
    crowded = crowded.select(F.col("__blob").alias("__key"), F.ceil(F.col("__n") / SHARE).cast("long").alias("__shares"))
    dealt = F.pmod(F.col("__row"), F.coalesce("__shares", F.lit(1)).cast("long"))
    rows = keys.join(F.broadcast(crowded), F.col("__blob") == F.col("__key"), "left").select("__id", "__blob", dealt.alias("__share"))
    copies = groups.join(F.broadcast(crowded), F.col("__blob") == F.col("__key"), "left")
    copies = copies.select(F.col("__blob").alias("__key"), "spans", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__shares", F.lit(1)).cast("long") - 1)).alias("__of"))
    return rows.join(copies, (F.col("__blob") == F.col("__key")) & (F.col("__share") == F.col("__of")), "left")


def _ledger(spark, path: str) -> DataFrame | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return spark.read.schema(f"__blob string, scanned array<string>, found {SPANS}").parquet(path)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
