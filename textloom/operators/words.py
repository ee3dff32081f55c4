"""Chinese words without a given dictionary: learnt from the corpus, then the best path through the lattice of each text.

A stretch of two to ``longest`` characters is a word if it is frequent, if it holds together (it is much more frequent than its parts
would make it by chance, wherever it is cut) and if it is free (what stands before it and after it varies). Every character alone is a word too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textloom.functions import text as T
from textloom.functions.automaton import Automaton
from textloom.functions.lattice import cut_words, pieces
from textloom.operators.keep import keeper

#: Characters of the dictionary's words in one automaton, at most; a larger dictionary is split into several, which are walked together.
AUTOMATON_CHARS = 2_000_000
#: Words of a dictionary, at most: it is held by every task.
MOST_WORDS = 5_000_000
#: Scores are logarithms in millionths, as whole numbers: sums don't depend on rounding.
SCALE = 1_000_000
#: Words that are no term candidates.
STOP_WORDS = ["一个", "什么", "怎么", "这样", "那样", "没有", "已经", "知道", "起来", "出来", "过来"]

_BEGIN, _END = "^", "$"


def _grams(stretch: Column, longest: int) -> Column:
    """All grams of 1 to ``longest`` + 1 characters of a stretch and its two borders, in linear time."""

    def all_sizes(chars: Column) -> Column:
        out, last = [chars], chars
        for k in range(2, longest + 2):
            last = F.filter(F.zip_with(last, F.slice(chars, F.lit(k), F.size(chars)), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull())
            out.append(last)
        return F.flatten(F.array(*out))

    return T.bind(F.concat(F.array(F.lit(_BEGIN)), F.regexp_extract_all(stretch, F.lit(T.HAN), F.lit(0)), F.array(F.lit(_END))), all_sizes)


def learn_words(docs: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 1.0, freedom: float = 0.5) -> DataFrame:
    """(word, n, score): all characters, and the stretches of 2 to ``longest`` that occur ``least`` times, hold together and are free.

    Cohesion is the least logarithm of n(w) N / (n(a) n(b)) over all cuts w = a b, N counting characters; freedom the smaller of the
    entropies of the neighbours before and after, where the border of a stretch is a neighbour. Both come from one table of counts of grams, which
    are combined before the shuffle; equal stretches are counted first and taken apart once. Null and empty texts have no words.
    """
    stretch = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{T.HAN}+"), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("times"))
    counts = stretch.select("times", F.explode(_grams(F.col("s"), longest)).alias("gram")).groupBy("gram").agg(F.sum("times").alias("n"))
    counts = keeper(docs.sparkSession)(counts, "grams")
    size = F.length("gram")
    pure = ~F.startswith("gram", F.lit(_BEGIN)) & ~F.endswith("gram", F.lit(_END))
    single = counts.filter((size == 1) & pure)
    whole = single.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    words = counts.filter(pure & size.between(2, longest) & (F.col("n") >= least)).select(F.col("gram").alias("word"), "n")
    entropy = F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    beside = counts.filter(size.between(3, longest + 1))
    after = beside.filter(~F.startswith("gram", F.lit(_BEGIN))).groupBy(F.left("gram", size - 1).alias("word")).agg(entropy.alias("after"))
    before = beside.filter(~F.endswith("gram", F.lit(_END))).groupBy(F.right("gram", size - 1).alias("word")).agg(entropy.alias("before"))
    part = lambda name: counts.filter(pure & (size < longest)).select(F.col("gram").alias(name), F.col("n").cast("double").alias(f"n_{name}"))
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    cuts = cuts.select("word", "n", F.left("word", F.col("i")).alias("a"), F.expr("substring(word, i + 1)").alias("b")).join(part("a"), "a").join(part("b"), "b")
    held = cuts.groupBy("word", "n").agg(F.min(F.log(F.col("n").cast("double") * whole / (F.col("n_a") * F.col("n_b")))).alias("held"))
    good = held.join(after, "word").join(before, "word").filter((F.col("held") >= cohesion) & (F.least("before", "after") >= freedom))
    score = F.floor(SCALE * F.log(F.col("n").cast("double") / whole)).cast("long").alias("score")
    return single.select(F.col("gram").alias("word"), "n", score).unionByName(good.select("word", "n", score))


def cutter(dictionary: DataFrame):
    """A function that gives the words of a column of texts, piece by piece (``dictionary``: word, score, which is learnt or given).

    The dictionary goes to all tasks as automata, after a check of its size: more than ``MOST_WORDS`` are an error, since a higher ``least`` is
    the remedy; beyond ``AUTOMATON_CHARS`` characters it is split by a hash. Characters that aren't in it are words of their own, at a score
    below all others.
    """
    number, chars, lowest = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.min("score"), F.lit(0))).first()
    if number > MOST_WORDS:
        raise ValueError(f"a dictionary of {number} words is too large to be held by every task; raise the least number of occurrences")
    parts = max(1, -(-chars // AUTOMATON_CHARS))
    automata, shard = [], F.pmod(F.xxhash64("word"), F.lit(parts))
    for i in range(parts):
        scores = {r.word: r.score for r in dictionary.filter(shard == i).select("word", "score").collect()}
        automaton = Automaton(list(scores))
        automata.append((automaton, np.array([scores[w] for w in automaton.words], dtype=np.int64)))

    def cut(texts: pa.Array) -> Iterator[pa.ListArray]:
        for piece in pieces(texts):
            yield cut_words(piece, automata, lowest - SCALE)

    return cut


def chinese_words(docs: DataFrame, dictionary: DataFrame | None = None, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(order, place, word) of the words of two characters or more that aren't stop words; ``dictionary`` is learnt from ``docs`` if none is given."""
    cut = cutter(keeper(docs.sparkSession)(learn_words(docs, text), "dictionary") if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for found in cut(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(found)), found], names=[order, "words"])
                done += len(found)

    bare = docs.select(order, F.regexp_replace(F.col(text), T.RUBY_SLOT, "").alias("bare"))
    rows = bare.mapInArrow(run, StructType([bare.schema[order], StructField("words", ArrayType(StringType()))]))
    words = rows.select(order, F.posexplode("words").alias("place", "word"))
    return words.filter((F.length("word") >= 2) & ~F.col("word").isin(STOP_WORDS))
