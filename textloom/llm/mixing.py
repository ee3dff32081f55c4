"""Mixing documents to target weights with soft domain membership (native).

A classifier over hashed words, fitted on labelled rows, gives each document a posterior over domains.
The document rates r >= 0 then solve the least squares problem: minimise the sum over domains k of
(E_k - T_k)^2, where E_k = sum over documents of r * tokens * posterior_k is the expected token total
of domain k and T_k its target. Projected gradient steps from r = 1 are
applied to all documents at once; a step is a vector of one number per domain, so a rate is a fold of
its document's posterior over the steps, and an iteration is one aggregation of a few sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bitmap_log2, bits_of, has_bit, stage, table

#: ASCII white space, as in the other contracts.
SPACE = "[\x20\x09-\x0d]+"
#: What is stripped from both ends of a word.
PUNCTUATION = """!"#$%&'()*+,-./:;<=>?@[]\\^_`{|}~"""
#: Slots that words are hashed to; the classifier has a weight per domain for some of them.
SLOTS = 1 << 18
#: Slots with weights at most.
MOST = 4096
#: Slots that may pass the significance test by chance, in expectation.
FALSE = 8.0


@dataclass(frozen=True)
class Classifier:
    """Per domain, the log odds of a document without telling words; per such slot, what a word there adds for each domain."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    slots: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)


def slot_of(word: Column) -> Column:
    """The slot of a word without the punctuation around it; null if nothing is left."""
    bare = F.btrim(word, F.lit(PUNCTUATION))
    return F.when(bare != "", F.pmod(F.xxhash64(bare), F.lit(SLOTS)))


def labelled_domains(labels: DataFrame, domain: Column, sample: int) -> DataFrame:
    """(doc_id, __domain) of at most ``sample`` labelled documents, those with the smallest hash of doc_id; of domains that contradict each other, the first by name."""
    known = labels.select("doc_id", domain.alias("__domain")).filter("doc_id is not null and __domain is not null")
    return known.groupBy("doc_id").agg(F.min("__domain").alias("__domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...], sample: int = 10_000, most: int = MOST, false: float = FALSE) -> Classifier:
    """Naive Bayes on the presence and absence of words in hashed slots.

    It is fitted on at most ``sample`` labelled documents: that bounds the broadcast list of ids and the model. Of rows that share an id, the
    text with the smallest hash counts, and texts that are equal count once (of contradicting domains, the first by name).
    A slot is used if it tells some domain significantly: by Chernoff's bound, the chance that so many of the n documents that
    have it are of that domain is at most ``false`` / slots seen twice; the ``most`` most significant are kept (ties: the smaller slot). Probabilities are smoothed by half a document.
    ``domain``: an expression over ``labels`` that gives one of ``domains`` or null (not used).
    """
    chosen = labelled_domains(labels, domain, sample)
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    seen = seen.groupBy("doc_id", "__domain").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    seen = stage(seen.groupBy("t.h").agg(F.min("__domain").alias("__domain"), F.min("t.text").alias("text")), "mixing-labelled")
    sizes = {r[0]: r[1] for r in seen.groupBy("__domain").count().collect()}
    total, k = sum(sizes.values()), len(domains)
    have = [F.count_if(F.col("__domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    words = seen.select("h", "__domain", F.explode(words_of(F.col("text"))).alias("w")).select("h", "__domain", slot_of(F.col("w")).alias("slot"))
    slots = words.filter("slot is not null").distinct().groupBy("slot").agg(F.count("*").alias("n"), *have).filter("n > 1")
    slots = stage(slots, "mixing-slots")
    evidence = [F.lit(0.0)]
    for i, d in enumerate(domains):
        q = min(max(sizes.get(d, 0) / max(total, 1), 1e-9), 1 - 1e-9)
        x = F.col(f"n{i}") / F.col("n")
        bound = F.col("n") * (F.when(x > 0, x * F.log(x / q)).otherwise(0.0) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - q))).otherwise(0.0))
        evidence.append(F.when(x > q, bound).otherwise(0.0))
    told = slots.withColumn("e", F.greatest(*evidence))
    least = max(float(np.log(max(slots.count(), 1) / false)), 0.0)
    found = sorted(told.filter(F.col("e") > least).orderBy(F.desc("e"), "slot").limit(most).collect(), key=lambda r: r["slot"])
    odds = np.array([[(r[f"n{j}"] + 0.5) / (sizes.get(d, 0) + 1.0) for j, d in enumerate(domains)] for r in found]).reshape(len(found), k)
    prior = np.log([(sizes.get(d, 0) + 0.5) / (total + 0.5 * k) for d in domains]) + np.log1p(-odds).sum(axis=0)
    return Classifier(domains, tuple(prior.tolist()), tuple(r["slot"] for r in found), tuple(map(tuple, (np.log(odds) - np.log1p(-odds)).tolist())))


def posteriors(docs: DataFrame, c: Classifier) -> DataFrame:
    """(doc_id, mark, tokens, p0.. one per domain) for every row; mark is a hash of the text, tokens are words. Every text is judged whole.

    All words are generated, hashed and looked up in one codegen stage; the table of weights has ``MOST`` + 1 rows at most, so it is
    broadcast. Only words that tell something go on, and one row more per document, which carries its tokens.
    """
    k, spark = len(c.domains), docs.sparkSession
    weights = spark.createDataFrame([(-1, *[0.0] * k), *[(s, *map(float, w)) for s, w in zip(c.slots, c.weights)]], "slot long, " + ", ".join(f"w{j} double" for j in range(k)))
    empty = lambda w: (w == "").cast("long")  # noqa: E731  # a split leaves empty strings at the ends only
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words_of(F.col("text")).alias("words"))
    tokens = F.size("words") - empty(F.col("words")[0]) - F.when(F.size("words") > 1, empty(F.element_at("words", -1))).otherwise(0)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", tokens.cast("long").alias("tokens"), F.array_append("words", F.lit(None).cast("string")).alias("words"))
    hits = rows.select("row", "doc_id", "mark", "tokens", F.explode("words").alias("w"))
    hits = hits.select("row", "doc_id", "mark", "tokens", F.when(F.col("w").isNull(), F.lit(-1).cast("long")).otherwise(slot_of(F.col("w"))).alias("slot"))
    once = hits.join(F.broadcast(weights), "slot").groupBy("row", "slot").agg(*[F.first(x).alias(x) for x in ("doc_id", "mark", "tokens", *[f"w{j}" for j in range(k)])])
    out = once.groupBy("row").agg(*[F.first(x).alias(x) for x in ("doc_id", "mark", "tokens")], *[(F.lit(c.prior[j]) + F.sum(f"w{j}")).alias(f"l{j}") for j in range(k)])
    top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
    norm = sum((F.exp(F.col(f"l{j}") - top) for j in range(k)), F.lit(0.0))
    return out.select("doc_id", "mark", "tokens", *[(F.exp(F.col(f"l{j}") - top) / norm).alias(f"p{j}") for j in range(k)])


def rate_after(steps: list[list[float]], cap: float | None = None) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{j}") * F.lit(float(g)) for j, g in enumerate(step)), F.lit(0.0)))
        rate = rate if cap is None else F.least(F.lit(float(cap)), rate)
    return rate


def fit_rates(post: DataFrame, target: list[float], rounds: int = 16, tolerance: float = 1e-6, least_gain: float = 1e-3, cap: float | None = None) -> tuple[Column, list[float]]:
    """(rate expression over ``post``, expected totals). ``target``: tokens per domain; ``cap``: the largest rate, if there is one.

    The gradient is taken per token and preconditioned by the second moments of the posteriors of documents with a
    free rate (positive and below the cap); it ends once all totals are met within ``tolerance`` of their sum, or a step lowers the error by less than
    ``least_gain``. Where a step doesn't lower the error, it is halved, and at last the plain gradient step with the safe length is taken.
    """
    k = len(target)
    t = np.array(target, dtype=float)
    scale = max(float(t.sum()), 1.0)

    def look(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = post.withColumn("r", rate_after(steps, cap))
        free = F.col("r") > 0 if cap is None else (F.col("r") > 0) & ((F.col("r") < cap) | F.lit(not steps))
        mass = [F.sum(F.col("r") * F.col("tokens") * F.col(f"p{j}")).alias(f"e{j}") for j in range(k)]
        second = [F.sum(F.when(free, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rated.agg(*mass, *second).first()
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
        return np.array([row[f"e{j}"] or 0.0 for j in range(k)]), m

    steps: list[list[float]] = []
    e, m = look(steps)
    for _ in range(rounds):
        miss = e - t
        if np.abs(miss).max() <= tolerance * scale:
            break
        ridge = m + np.eye(k) * max(1e-9 * np.trace(m), 1e-12)
        newton, plain = np.linalg.solve(ridge, miss), miss / max(np.linalg.eigvalsh(m).max(), 1e-12)
        tried = None
        for step in (newton, newton / 2, newton / 4, plain):
            e2, m2 = look([*steps, step.tolist()])
            if ((e2 - t) ** 2).sum() < (miss**2).sum() * (1 - 1e-9):
                tried = (step, e2, m2)
                break
        if tried is None:
            break
        steps.append(tried[0].tolist())
        gone = (miss**2).sum() - ((tried[1] - t) ** 2).sum()
        e, m = tried[1], tried[2]
        if gone <= least_gain * (miss**2).sum():
            break
    return rate_after(steps, cap), e.tolist()


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], total: float | str | None = None, sample: int = 10_000, cap: float | None = None) -> tuple[DataFrame, Classifier]:
    """((doc_id, mark, tokens, p0.., rate, copies), classifier): a row per input row.

    ``weights``: share of the token total that each domain is to have; ``total``: that total, by default the input's tokens; a domain's
    name stands for that domain's expected tokens in the input. ``cap``: no rate is above it.
    ``copies``: the rate rounded up or down by a hash of doc_id and mark, so that its mean is the rate; 0 drops the document.
    Null texts count as empty and have no tokens. Null ids and repeated rows are rated like others, equal (doc_id, text) alike. Columns
    beyond doc_id and text are ignored; an empty table gives no rows; without labels all documents get equal rates.
    """
    names = tuple(weights)
    c = fit_classifier(docs, labels, domain, names, sample)
    post = stage(posteriors(docs, c), "mixing-posteriors")
    if not isinstance(total, float | int):
        expected = F.col("tokens") * F.col(f"p{names.index(total)}") if total else F.col("tokens")
        total = post.agg(F.sum(expected)).first()[0] or 0
    share = sum(weights.values())
    rate, _ = fit_rates(post, [float(total) * weights[d] / share for d in names], cap=cap)
    out = post.withColumn("rate", rate)
    luck = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", F.floor(F.col("rate") + luck).cast("long")), c


def take(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says, all columns unchanged; ``rated``: from ``mix`` over the same documents.

    Rows taken once aren't shuffled: a bitmap of the others (64 MiB at most) tells most of them apart.
    """
    other = rated.filter("copies <> 1").groupBy("doc_id", "mark").agg(F.first("copies").alias("__copies"))
    other = stage(other.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of"), "__copies", F.xxhash64("doc_id", "mark").alias("__key")), "mixing-other")
    log2 = bitmap_log2(other.count())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("__mark"))
    rows = rows.withColumn("__own", F.xxhash64("__row.doc_id", "__mark"))
    rows = has_bit(rows, stage(bits_of(other, "__key", log2), "mixing-bits"), "__own", "__maybe", log2)
    once = rows.filter("not __maybe").select("__row")
    rest = rows.filter("__maybe").join(other, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of")), "left")
    rest = rest.withColumn("__n", F.coalesce("__copies", F.lit(1))).filter("__n > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))))
    return once.unionByName(rest.select("__row")).select("__row.*")


def quality_domain() -> Column:
    """Domains of the labels table: toxic, else low or good by quality; null where both are missing."""
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "low")


OP9_WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out, c = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_domain(), OP9_WEIGHTS)
    return out.select("doc_id", "tokens", *[F.round(f"p{j}", 6).alias(f"p_{d}") for j, d in enumerate(c.domains)], F.round("rate", 6).alias("rate"), "copies")
