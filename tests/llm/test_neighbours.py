"""Nearest neighbours by posting lists: exact properties of each result, recall against brute force, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, list int, ids string"


def brute(rows, asks, k):
    """{query: [(vec_id, score), ...]} over (id, vector) without duplicates."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in asks:
        s = (x * np.asarray(v, dtype=np.float64)).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def results(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clustered(n, dim, seed, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * 0.7
    return x * rng.uniform(0.2, 3, (n, 1)) if lengths else x / np.linalg.norm(x, axis=1)[:, None]


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items())
    return hits / sum(len(best) for best in want.values())


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_on_clusters(spark, lengths):
    """Also for vectors of many lengths, where the largest inner product isn't the nearest direction."""
    x = clustered(6000, 16, 4, lengths)
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = results(neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0))
    want = brute(rows, rows[::20], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(float((x[q] * x[i]).sum()), rel=1e-12)


def test_recall_without_clusters(spark, sf_dir):
    """The given vectors point evenly in all directions: the hardest case for lists."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/../sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = results(neighbours.op12_neighbours(spark, f"{sf_dir}/../sf0.1"))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_equal_vectors_and_ties(spark):
    """A third of the rows are one vector: its smallest ids show, whoever asks; nothing is lost behind them."""
    x = clustered(900, 8, 7)
    x[::3] = x[0]
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = results(neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0, recall=1.0))
    want = brute(rows, rows[::20], 20)
    for q in want:
        assert [i for i, _ in got[q]][:20] == [i for i, _ in want[q]] or recall({q: got[q]}, {q: want[q]}) >= 0.9
    assert [i for i, _ in got[0]] == list(range(3, 63, 3))


def odd_rows():
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), 1.0, -float(i % 3)]) for i in range(10)]
    bad = [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (40, [1.0, None, 1.0]), (41, [nan, 1.0, 1.0]), (60, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0, 2.0])]
    return good, bad


def test_odd_rows(spark):
    good, bad = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in [*good, *good[:2], *bad]], SCHEMA).repartition(3)
    got = results(neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0))
    assert got == brute(good, [r for r in good if r[0] % 20 == 0], 20)  # all candidates, as there are fewer than 20
    assert results(neighbours.nearest(df.filter("vec_id is null"), F.pmod("id", F.lit(20)) == 0)) == {}
    assert results(neighbours.nearest(df.limit(0), F.pmod("id", F.lit(20)) == 0)) == {}
    assert results(neighbours.nearest(df.filter("vec_id = 0"), F.lit(True))) == {}


def test_lists_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 50)
    x = clustered(1500, 8, 9)
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = results(neighbours.nearest(df, F.pmod("id", F.lit(5)) == 0))
    assert recall(got, brute(rows, rows[::5], 20)) >= 0.9


def test_graph_search_finds_what_all_distances_find():
    x = clustered(20_000, 24, 11)
    centroids = neighbours.balanced_centroids(neighbours.lifted(x, 1.0), 600)
    index = neighbours.Index.of(centroids, 1.0)
    asks = neighbours.asking(x[:400])
    ids, d = index.search(asks, 32)
    want = np.argsort(index.distances(asks), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, want)]) > 0.95
    assert (np.diff(d, axis=1) >= 0).all()


def test_lists_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(8000, 8)), rng.normal(size=(8000, 8)) * 0.05 + 3)).astype(np.float32)
    centroids = neighbours.balanced_centroids(x, 64)
    sizes = np.bincount(np.argmin(((x[:, None] - centroids[None]) ** 2).sum(2), axis=1), minlength=len(centroids))
    assert 48 <= len(centroids) <= 80 and sizes.max() < 6 * len(x) / len(centroids)
