"""LM scoring by masked pseudo-likelihood.

A small network sees the ``side`` words on either side of a token and predicts the token itself: window
embeddings -> tanh layer -> a class, and within the class a leaf, both by softmax. Each of the most frequent words has a leaf of its
own; all other words have a slot each (or share one, by hash), the slots are dealt to bands of similar frequency, a leaf each, and a word's
share within its band comes from its own count. So P(token | both sides) is a distribution over all words of the corpus.
A document's score is the sum over its tokens of log P. The counts come from the whole corpus, and the table of slots grows with
it: as many as words that occur twice, ``SLOTS`` at most, which bounds what is broadcast at 64 MiB. Each partition trains on all its tokens in numpy
from the same start, and the networks are averaged by their token counts, in ``rounds`` passes; so the network, and with it the last digits
of a score, depend on how the rows are dealt to partitions. The network has a fixed size (some 150 kB) and is sent to the tasks with the code.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lean, stage, table

SEED = 42
#: Slots for words without a leaf of their own, at most: eight bytes each.
SLOTS = 1 << 23
CHUNK = 4096


def words_of(text: str | bytes) -> list[bytes]:
    """The words of a text as UTF-8; without an argument, ``bytes.split`` cuts at just the white space of ``common.WORD``."""
    return (text.encode() if isinstance(text, str) else text).split()


def encoded(b: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch as UTF-8, as they lie in it."""
    return (t.as_py() for t in b.column("text").cast(pa.binary()))


class _Ids(dict):
    """Word, as UTF-8 -> id: the number of a known word, else one more than those and its slot; ids of other words are kept up to a bound."""

    def __init__(self, known: dict[bytes, int], slots: int, most: int = 300_000):
        super().__init__(known)
        self.known, self.slots, self.most = known, slots, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        value = self[word] = len(self.known) + (xxhash.xxh64_intdigest(word, SEED) & (self.slots - 1))
        return value

    def __reduce__(self):
        return _Ids, (self.known, self.slots, self.most)


@dataclass
class Shape:
    side: int = 2
    dim: int = 8
    hidden: int = 16
    batch: int = 8192
    rate: float = 0.25
    classes: int = 40
    leaves: int = 48
    bands: int = 64
    #: rows of embeddings that words without a leaf of their own share
    shared: int = 1024
    seed: int = 7
    names: tuple[str, ...] = field(default=("E", "W", "b", "V", "c", "G", "U", "B"))

    @property
    def top(self) -> int:
        return self.classes * self.leaves - self.bands


@dataclass
class Vocabulary:
    """``ids``: the words with a leaf of their own. ``leaf`` and ``inside``: for each slot, the leaf and the log share of a word of the slot within it."""

    ids: dict[str, int]
    leaf: np.ndarray
    inside: np.ndarray
    shape: Shape

    def __post_init__(self):
        self.seen = _Ids({w.encode(): i for w, i in self.ids.items()}, len(self.leaf))

    def look_up(self, words: list[str] | list[bytes]) -> np.ndarray:
        if words and isinstance(words[0], str):
            words = [w.encode() for w in words]
        return np.fromiter(map(self.seen.__getitem__, words), dtype=np.int32, count=len(words))

    def target(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, leaf within the class, log share within the leaf) of each id."""
        slot = ids - len(self.ids)
        rare = slot >= 0
        leaf = np.where(rare, self.leaf[slot * rare], ids)
        return leaf // self.shape.leaves, leaf % self.shape.leaves, np.where(rare, self.inside[slot * rare], 0.0)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The row of embeddings of each id."""
        known = len(self.ids)
        return np.where(ids < known, ids, known + (ids - known) % self.shape.shared).astype(np.int32)

    @property
    def edge(self) -> int:
        """The row of the text's edge."""
        return len(self.ids) + self.shape.shared


def count_words(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(word, n) over all texts; a task adds up at most ``held`` words before it passes them on."""

    def batch(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in encoded(b):
                seen.update(words_of(text))
                if len(seen) > held:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    return lean(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def slot_counts(counts: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each slot; ``counts``: (word, n). Eight bytes a slot reach the driver."""

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([xxhash.xxh64_intdigest(w, SEED) & (slots - 1) for w in b.column("word").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"slot": at, "n": b.column("n")})

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, types = np.zeros(CHUNK, "<f4"), np.zeros(CHUNK, "<f4")
        n[pdf["slot"] % CHUNK], types[pdf["slot"] % CHUNK] = pdf["n"], pdf["types"]
        return pd.DataFrame({"chunk": [key[0]], "n": [n.tobytes()], "types": [types.tobytes()]})

    sums = lean(counts).mapInArrow(slot, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    chunks = sums.groupBy(F.expr(f"slot div {CHUNK}").alias("chunk")).applyInPandas(pack, "chunk long, n binary, types binary").collect()
    n, types = np.zeros(max(slots, CHUNK), "<f4"), np.zeros(max(slots, CHUNK), "<f4")
    for r in chunks:
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        n[at], types[at] = np.frombuffer(r["n"], "<f4"), np.frombuffer(r["types"], "<f4")
    return n[:slots], types[:slots]


def vocabulary(counts: DataFrame, shape: Shape, most: int = SLOTS) -> Vocabulary:
    """The most frequent words (ties: the smaller one) and the table of slots, from the counts of all words."""
    best = [tuple(r) for r in counts.orderBy(F.desc("n"), "word").limit(shape.top).collect()]
    lowest = best[-1] if best else ("", 0)
    others = counts.filter((F.col("n") < lowest[1]) | ((F.col("n") == lowest[1]) & (F.col("word") > lowest[0])))
    slots = min(most, 1 << max(10, others.filter("n > 1").count().bit_length()))
    n, types = slot_counts(others, slots)
    each = np.maximum(n, 0.5) / np.maximum(types, 1)  # tokens of a word of the slot
    order = np.argsort(-each, kind="stable")
    mass = np.cumsum(np.maximum(n, 0.5)[order], dtype=np.float64)
    band = np.empty(slots, dtype=np.int32)
    band[order] = np.minimum(mass / mass[-1] * shape.bands, shape.bands - 1).astype(np.int32)
    total = np.bincount(band, weights=each.astype(np.float64) * np.maximum(types, 1), minlength=shape.bands)
    return Vocabulary({w: i for i, (w, _) in enumerate(best)}, (shape.top + band).astype(np.int32), (np.log(each) - np.log(total[band])).astype(np.float32), shape)


def fresh(v: Vocabulary, s: Shape) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    width = 2 * s.side * s.dim
    normal = lambda *shape, sd: rng.normal(0, sd, shape).astype(np.float32)
    return {
        "E": normal(v.edge + 1, s.dim, sd=0.3), "W": normal(width, s.hidden, sd=width**-0.5), "b": np.zeros(s.hidden, np.float32),
        "V": normal(s.hidden, s.classes, sd=0.1), "c": np.zeros(s.classes, np.float32),
        "G": 1 + normal(s.classes, s.hidden, sd=0.3), "U": normal(s.hidden, s.leaves, sd=0.1), "B": np.zeros((s.classes, s.leaves), np.float32),
    }


def grouped(texts: Iterable[str | bytes], v: Vocabulary, s: Shape, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(tokens of each text, text of each token, windows, class, leaf, log share) of runs of texts with ``least`` tokens or more.

    A window is the ``side`` rows on the left and on the right of a position, the edge's row beyond the ends of its text.
    """
    offsets = np.array([k for k in range(-s.side, s.side + 1) if k])

    def made(words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, ...]:
        ids, n = v.look_up(words), np.array(sizes)
        of = np.repeat(np.arange(len(n)), n)
        padded = np.full(len(ids) + s.side * (len(n) + 1), v.edge, np.int32)
        at = np.arange(len(ids)) + s.side * (1 + of)
        padded[at] = v.rows(ids)
        return n, of, padded[at[:, None] + offsets], *v.target(ids)

    words, sizes = [], []
    for text in texts:
        found = words_of(text)
        words += found
        sizes.append(len(found))
        if len(words) >= least:
            yield made(words, sizes)
            words, sizes = [], []
    if sizes:
        yield made(words, sizes)


def scores(m: dict[str, np.ndarray], ctx: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """(inputs, hidden layer, the class's gate, gated hidden layer, scores of the classes, scores of the leaves of the class)."""
    x = m["E"].take(ctx, axis=0).reshape(len(ctx), -1)
    h = x @ m["W"]
    h += m["b"]
    np.tanh(h, out=h)
    gate = m["G"].take(cls, axis=0)
    gated = h * gate
    z, y = h @ m["V"], gated @ m["U"]
    z += m["c"]
    y += m["B"].take(cls, axis=0)
    return x, h, gate, gated, z, y


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums), in place; scores are first lowered by their largest where they could overflow."""
    if z.size and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def log_probability(m: dict[str, np.ndarray], ctx: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log P(class and leaf | both sides) of each position."""
    *_, z, y = scores(m, ctx, cls)
    at = np.arange(len(cls))
    p, p_sum = softmax(z)
    q, q_sum = softmax(y)
    tiny = np.finfo(p.dtype).tiny
    return np.log(np.maximum(p[at, cls], tiny) / p_sum) + np.log(np.maximum(q[at, leaf], tiny) / q_sum)


def learn(m: dict[str, np.ndarray], g2: dict[str, np.ndarray], ctx: np.ndarray, cls: np.ndarray, leaf: np.ndarray, rate: float) -> None:
    """One adaptive gradient step on a batch, in place."""
    x, h, gate, gated, z, y = scores(m, ctx, cls)
    n, at = len(cls), np.arange(len(cls))
    p, p_sum = softmax(z)
    q, q_sum = softmax(y)
    p /= p_sum[:, None]
    q /= q_sum[:, None]
    p[at, cls] -= 1
    q[at, leaf] -= 1
    one = np.zeros_like(p)
    one[at, cls] = 1
    d_gated = q @ m["U"].T
    dh = (p @ m["V"].T + d_gated * gate) * (1 - h * h)
    rows, dim = m["E"].shape
    dx = (dh @ m["W"].T).reshape(-1, dim)
    spots = (ctx.reshape(-1, 1) * dim + np.arange(dim, dtype=np.int32)).ravel()
    grads = {
        "V": h.T @ p, "c": p.sum(axis=0), "W": x.T @ dh, "b": dh.sum(axis=0), "U": gated.T @ q, "B": one.T @ q, "G": one.T @ (d_gated * h),
        "E": np.bincount(spots, weights=dx.ravel(), minlength=rows * dim).reshape(rows, dim),
    }
    for k, g in grads.items():
        g = (g / n).astype(m[k].dtype)
        g2[k] += g * g
        m[k] -= rate * g / (np.sqrt(g2[k]) + 1e-6)


def train_round(docs: DataFrame, start: dict[str, np.ndarray], shared, s: Shape, fan: int = 64) -> dict[str, np.ndarray]:
    """Train in every partition from ``start``; the mean network, weighted by tokens. ``fan`` partial sums reach the driver. ``shared``: the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        m = {k: a.copy() for k, a in start.items()}
        g2 = {k: np.full(a.shape, 1e-8, np.float32) for k, a in start.items()}
        total = 0
        texts = (t for b in batches for t in encoded(b))
        for _, _, ctx, cls, leaf, _ in grouped(texts, v, s, s.batch):
            for at in range(0, len(cls), s.batch):
                some = slice(at, at + s.batch)
                learn(m, g2, ctx[some], cls[some], leaf[some], s.rate)
            total += len(cls)
        if total:
            yield pa.RecordBatch.from_pydict({"n": [float(total)], "model": [pickle.dumps({k: a * np.float64(total) for k, a in m.items()})]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, acc = 0.0, None
        for pdf in batches:
            for k, blob in zip(pdf["n"], pdf["model"]):
                one = pickle.loads(blob)
                n, acc = n + k, one if acc is None else {a: acc[a] + one[a] for a in acc}
        if acc is not None:
            yield pd.DataFrame({"n": [n], "model": [pickle.dumps(acc)]})

    kind = "n double, model binary"
    parts = lean(docs).mapInArrow(run, kind).repartition(fan).mapInPandas(add, kind).collect()
    if not parts:
        return start
    n = sum(r["n"] for r in parts)
    sums = [pickle.loads(r["model"]) for r in parts]
    return {k: (sum(x[k] for x in sums) / n).astype(np.float32) for k in start}


def score(texts: Iterable[str | bytes], m: dict[str, np.ndarray], v: Vocabulary, s: Shape, step: int = 1 << 10) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sum of log P(token | both sides)) of each text."""
    counts, sums = [np.empty(0, np.int64)], [np.empty(0)]
    for n, of, ctx, cls, leaf, inside in grouped(texts, v, s, 8 * step):
        logs = inside.astype(np.float64)
        for at in range(0, len(cls), step):
            some = slice(at, at + step)
            logs[some] += log_probability(m, ctx[some], cls[some], leaf[some])
        counts.append(n)
        sums.append(np.bincount(of, weights=logs, minlength=len(n)))
    return np.concatenate(counts), np.concatenate(sums)


def score_documents(docs: DataFrame, shape: Shape | None = None, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_tokens, log_likelihood, mean_log_likelihood).

    Null and empty texts have 0 tokens, sum 0 and a null mean. Repeated rows train and score as often
    as they occur, null ids stay null; other columns are ignored; an empty input gives no rows. Texts are read whole.
    """
    s, spark = shape or Shape(), docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(vocabulary(stage(count_words(rows.select("text")), "lm-words"), s))
    m = fresh(shared.value, s)
    for _ in range(rounds):
        m = train_round(rows.select("text"), m, shared, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            n, total = score(encoded(b), m, v, s)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "log_likelihood": pa.array(total, pa.float64())})

    out = lean(rows).mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
