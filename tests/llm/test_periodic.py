"""Periodic runs against brute force: edges and matches, runs, and the registered query."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from textloom.llm import periodic


def edges_brute(x):
    after, match = [], []
    for i in range(len(x)):
        j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
        k = 0
        while j + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        after.append(j)
        match.append(k)
    return after, match


def runs_brute(w, least=24, times=3):
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                found.append((s, i + p - s, p))
    smallest = [r for r in found if not any(s <= r[0] and s + n >= r[0] + r[1] and q < r[2] for s, n, q in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def sequences(seed):
    rng = random.Random(seed)
    for k in range(400):
        size = rng.randint(1, 4)
        draw = lambda n: [rng.randrange(size) for _ in range(n)]  # noqa: E731, B023
        yield draw(rng.randint(1, 60)) if k % 2 else draw(4) + draw(rng.randint(1, 9)) * rng.randint(2, 9) + draw(5) + draw(2) * rng.randint(1, 6)


@pytest.mark.parametrize("seed", range(3))
def test_edges_and_runs(seed):
    for x in sequences(seed):
        assert periodic.lyndon_edges(x) == edges_brute(x)
        for least in (6, 24):
            assert periodic.find_runs(x, least) == runs_brute(x, least), x


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0] * (n // 2) + [1] + [0] * (n // 2), lambda n: (([0] * 30 + [1]) * 7 + [2]) * (n // 218)])
def test_no_letter_twice(make):
    """The comparisons that both orders need grow in proportion to the text, also where it is all repetition."""

    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    def cost(n):
        Counted.seen = 0
        x = [Counted(c) for c in make(n)]
        periodic.lyndon_edges(x)
        return Counted.seen / len(x)

    assert cost(8000) < 4 and cost(16000) < 1.1 * cost(8000) + 0.1


def text_of(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def row_brute(doc_id, text):
    words = text_of(doc_id, text)
    runs = runs_brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *digests)


LONG = "so " * 40_000 + " ".join(f"w{i % 211}" for i in range(2_000))
# the ids whose texts the contract changes
CHANGED = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (None, "null " * 30), (4, "a b " * 12), (4, "a b " * 12), (5, "x" + " y" * 23), (6, "x" + " y" * 24), (7, "é\x1fz 　 日本語 " * 30), (8, "one two " * 11 + "one two")]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))) for i in range(10, 80)]
    return rows + [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 300)))) for i in CHANGED]


def sort_key(row):
    return tuple((x is not None, x) for x in row)


def test_query_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=sort_key) == sorted((row_brute(*r) for r in rows), key=sort_key)


def test_query_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, sf_dir).collect()]
    assert sorted(got) == sorted(row_brute(*r) for r in rows)
    assert sum(r[1] for r in got)


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    (row,) = periodic.periodic_runs(df).collect()
    assert [tuple(r) for r in row.runs] == [(0, 40_000, 1), (40_000, 2_000, 211)] and len(row.text.split()) == 1 + 211
    assert periodic.periodic_runs(df.limit(0)).collect() == []
