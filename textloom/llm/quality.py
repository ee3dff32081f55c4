"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a ratio of base counts exceeds a cutoff. Cutoffs are set per
stratum (language) from labelled documents, split by content (near copies fall on one side): the tuning half proposes
cutoffs and a ladder of looser ones, the holdout half tests the joint decision of the rules on each rung, from the
loosest on. A rung passes if the exact binomial probability of so few rejected good documents, were the
true false-rejection rate ``alpha``, is at most ``delta`` divided by the number of strata. Testing in a
fixed order and stopping at the first failure needs no further correction.

What is promised: with probability 1 - ``delta``, the cutoffs reject in no stratum more than ``alpha`` of the good documents
that pass the base rule. The base rule is fixed and not part of that promise; what both lose together
is reported by ``certificate``, with an exact upper bound. A stratum where no rung passes (at ``alpha`` 2 %, ``delta`` 5 % and four
strata, any with fewer than 217 good documents in the holdout) rejects by the base rule only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, bitmap_log2, bits_of, has_bit, lean, stage, table

_WORD = re.compile(WORD)
_SYMBOL = re.compile("[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5

#: Shares from 0.5 % to 90 %, and mean word lengths.
_SHARES = tuple(round(0.005 * 1.24**k, 4) for k in range(25))
_LENGTHS = tuple(float(x) for x in range(6, 31))


@dataclass(frozen=True)
class Rule:
    name: str
    over: str
    under: str
    grid: tuple[float, ...]


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", _SHARES),
    Rule("repeat_share", "n_repeat_words", "n_words", _SHARES),
    Rule("dup_line_share", "n_dup_lines", "n_words", _SHARES),
    Rule("word_length", "word_chars", "n_words", _LENGTHS),
)
#: Rungs above the proposed cutoff, in grid steps; the last is the proposal.
LADDER = (8, 4, 2, 1, 0)
OFF = 1e300
#: Strata that get cutoffs of their own, those with most labelled documents; all others are one more stratum, ``REST``.
STRATA = 256
REST = "\x00rest"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            change = np.zeros(n + 1, dtype=np.int64)
            at = np.array([i for i, w in enumerate(windows) if seen[w] > 1])
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            repeated = int((np.cumsum(change)[:n] > 0).sum())
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def content_key(text: str) -> int:
    """The least hash of the ``WINDOW``-word windows of a text: near copies mostly share it. No words give 0."""
    words = _WORD.findall(text)
    shingles = map(" ".join, zip(*(words[i:] for i in range(min(WINDOW, len(words))))))
    return min(map(xxhash.xxh64_intdigest, shingles), default=0) >> 1


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def features(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, stratum, the five base counts), a row per input row, repeated rows included.

    Null texts have no words, a null stratum is "", null ids stay null. Texts are counted whole. Other columns are ignored; an empty input gives no rows. ``keyed``
    adds content_key, which ``calibrate`` splits by.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            made = list(zip(*map(base_counts, texts))) or [()] * len(COUNTS)
            key = {"content_key": pa.array(map(content_key, texts), pa.int64())} if keyed else {}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "stratum": b.column("stratum"), **{c: pa.array(x, pa.int64()) for c, x in zip(COUNTS, made)}, **key})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return lean(rows).mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + (", content_key long" if keyed else ""))


def judged(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled documents; of labels that contradict each other, the lowest counts."""
    return labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that may be labelled, by a bitmap of the labels' ids; no text is shuffled."""
    log2 = bitmap_log2(labels.count())
    bits = stage(bits_of(judged(labels).select(F.xxhash64(F.col("doc_id").cast("string")).alias("__key")), "__key", log2), "quality-ids")
    rows = docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("string")))
    return has_bit(rows, bits, "__key", "__labelled", log2).filter("__labelled").select(*docs.columns)


def value(rule: Rule) -> Column:
    return F.col(rule.over) / F.greatest(F.col(rule.under), F.lit(1))


def few_enough(k: int, n: int, alpha: float, level: float) -> bool:
    """Whether P(Binomial(n, alpha) <= k) <= level, summed exactly from k down."""
    if n == 0 or k >= n * alpha:
        return False
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha))
        total += term
        if total > level or term < 1e-18 * total:
            break
        i -= 1
    return total <= level


def upper_bound(k: int, n: int, level: float) -> float:
    """The least rate that ``few_enough`` rules out for k of n: an exact upper confidence bound (1 without data)."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if few_enough(k, n, mid, level) else (mid, high)
    return high


def _holdout(counts: DataFrame, labels: DataFrame, strata: int) -> tuple[DataFrame, list[str]]:
    """Labelled texts with ``hold`` and ``s``, their stratum or ``REST``, and the strata with names of their own (at most ``strata``).

    Copies of a text, near ones included as far as ``content_key`` tells, are one trial, not several: of those in a stratum, the one with the
    lowest label and then the smallest id counts.
    """
    rows = counts.join(judged(labels), "doc_id")
    one = F.min_by(F.struct("quality", *COUNTS), F.struct("quality", "doc_id")).alias("x")
    once = rows.groupBy("content_key", "stratum").agg(one).select("content_key", "stratum", "x.*")
    rows = stage(once.withColumn("hold", F.pmod(F.xxhash64("content_key"), F.lit(2)) == 1), "quality-labelled")
    named = [r["stratum"] for r in rows.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(strata).collect()]
    return rows.withColumn("s", F.when(F.col("stratum").isin(named), F.col("stratum")).otherwise(F.lit(REST))), named


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, price: float = 20.0, rules: tuple[Rule, ...] = RULES, strata: int = STRATA) -> dict[str, tuple[float, ...]]:
    """Cutoffs {stratum: one per rule} from all labelled rows of ``counts`` (see ``features``, keyed).

    ``labels``: (doc_id, quality 0/1); null labels and ids are left out, of contradicting ones the lowest counts. Only counts per (stratum, rule, grid step) reach the driver. ``price``: a
    good document lost in tuning outweighs so many bad ones caught; ties take the looser cutoff. No labels, or too few, give no cutoffs. If strata were pooled, the cutoffs of
    the pool are under ``REST`` and hold for all strata that have no others, unlabelled ones included.
    """
    rows, named = _holdout(counts, labels, strata)
    rows = rows.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))

    # tuning: how many good and bad documents lie above each grid step
    step = lambda r: sum(((value(r) > t).cast("int") for t in r.grid), F.lit(0))
    steps = F.array(*[F.struct(F.lit(i).alias("rule"), step(r).alias("step")) for i, r in enumerate(rules)])
    bins = rows.filter("not hold").select("s", "quality", F.explode(steps).alias("x")).groupBy("s", "quality", "x.rule", "x.step").count().collect()
    above: dict[str, np.ndarray] = {}
    for s, q, rule, at, n in bins:
        above.setdefault(s, np.zeros((len(rules), max(len(r.grid) for r in rules), 2)))[rule, :at, int(q > 0)] += n
    proposal = {}
    for s, a in above.items():
        gain = a[:, :, 0] - price * a[:, :, 1]
        best = [max((g, k) for k, g in enumerate(row)) for row in gain]  # ties: the loosest
        proposal[s] = [k if g > 0 else None for g, k in best]

    # holdout: the joint decision of each rung
    def cutoffs(s: str, rung: int) -> tuple[float, ...]:
        return tuple(OFF if k is None or k + rung >= len(r.grid) else r.grid[k + rung] for r, k in zip(rules, proposal[s]))

    if not proposal:
        return {}
    tested = counts.sparkSession.createDataFrame([(s, [list(cutoffs(s, j)) for j in LADDER]) for s in sorted(proposal)], "s string, rungs array<array<double>>")
    good = rows.filter("hold and quality > 0").join(F.broadcast(tested), "s")  # a row per stratum: strata + 1 at most
    lost = [F.count_if(rejects(rules, lambda i, j=j: F.col("rungs")[j][i])).alias(f"k{j}") for j in range(len(LADDER))]
    out = {}
    for r in good.groupBy("s").agg(F.count("*").alias("n"), *lost).collect():
        passed = None
        for j, rung in enumerate(LADDER):
            if not few_enough(r[f"k{j}"], r["n"], alpha, delta / len(proposal)):
                break
            passed = rung
        if passed is not None:
            out[r["s"]] = cutoffs(r["s"], passed)
    if REST in out:  # a named stratum that wasn't certified must not fall back to the pool
        out |= {s: (OFF,) * len(rules) for s in named if s not in out}
    return out


def certificate(counts: DataFrame, labels: DataFrame, cuts: dict[str, tuple[float, ...]], delta: float = 0.05, rules: tuple[Rule, ...] = RULES, strata: int = STRATA) -> dict[str, dict]:
    """What the holdout says of the whole decision: {stratum: good, base_lost, rule_lost, upper}.

    ``base_lost``: good documents that the base rule rejects; ``rule_lost``: further ones that a cutoff rejects; ``upper``: the exact bound on the rate
    of both together, corrected for the strata and for having chosen among the rungs.
    """
    rows, _ = _holdout(counts, labels, strata)
    told = verdict(rows.filter("hold and quality > 0"), cuts, rules)
    found = told.groupBy("s").agg(F.count("*").alias("good"), F.count_if("base_failed").alias("base"), F.count_if("not kept").alias("lost")).collect()
    level = delta / max(1, len(found) * len(LADDER))
    return {r["s"]: {"good": r["good"], "base_lost": r["base"], "rule_lost": r["lost"] - r["base"], "upper": upper_bound(r["lost"], r["good"], level)} for r in found}


def rejects(rules: tuple[Rule, ...], cutoff) -> Column:
    out = F.lit(False)
    for i, r in enumerate(rules):
        out = out | (value(r) > cutoff(i))
    return out


def verdict(counts: DataFrame, cuts: dict[str, tuple[float, ...]], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept. A stratum without cutoffs is judged by those of ``REST``, if there are any, else by the base rule."""
    rest = cuts.get(REST, (OFF,) * len(rules))
    own = [x for s, c in sorted(cuts.items()) if s != REST for x in (F.lit(s), F.array(*map(F.lit, c)))]
    cut = F.array(*map(F.lit, rest))
    if own:  # STRATA entries at most
        cut = F.coalesce(F.try_element_at(F.create_map(*own), F.col("stratum")), cut)
    out = counts.withColumn("__cut", cut).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    bad = rejects(rules, lambda i: F.col("__cut")[i])
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__cut")


def keep_good(docs: DataFrame, cuts: dict[str, tuple[float, ...]], rules: tuple[Rule, ...] = RULES, stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, all columns unchanged; texts are judged where they are.

    Null texts have no words and go; a null stratum is ""; repeated rows stay or go together; an empty input gives no rows.
    """
    rest = cuts.get(REST, (OFF,) * len(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep = []
            for text, s in zip(b.column(text_col).to_pylist(), b.column(stratum).to_pylist()):
                c = dict(zip(COUNTS, base_counts(text or "")))
                limits = cuts.get("" if s is None else str(s), rest)
                keep.append(not base_failed(c["n_words"], c["n_repeat_words"]) and not any(c[r.over] / max(c[r.under], 1) > x for r, x in zip(rules, limits)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return lean(docs).mapInArrow(run, docs.schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cuts = calibrate(features(labelled(docs, labels), keyed=True), labels)
    return verdict(features(docs), cuts).select("doc_id", *COUNTS, "base_failed", "kept")
