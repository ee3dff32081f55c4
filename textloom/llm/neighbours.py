"""Approximate nearest neighbours (largest inner product) by balanced posting lists, after SPANN.

* Vectors get one more component, so that all have the same length and the largest inner product is the least distance.
* Centroids come from balanced hierarchical clustering of a sample of bounded bytes (``SAMPLE_BYTES``): a cluster is split into as many
  lists as its share of the sample, so lists are about even. Their number follows the rows.
* A vector goes into its nearest list and, if it is near the boundary, into up to ``replicas`` - 1 more. Every vector is indexed.
* Centroids are found by a graph held in memory: edges to near centroids in different directions, best-first search for
  many vectors at once.
* A query searches the lists whose centroid is at most ``ratio`` times as far as its nearest one. The ratio is measured: for a bounded set
  of queries the true neighbours are found in one pass over all rows, and the ratio is the one that reaches ``recall`` of them.
  Where such lists hold fewer rows than asked for, the next ones are taken, all of them if need be.
* The nearest lists are searched first. What is found there bounds the result from below, and the other lists only return what reaches the
  bound, so that the rows returned don't grow with the number of lists.

Lists are balanced once more where all rows are in: a list, or a list's queries, beyond ``CELL`` is dealt over cells, and a
task holds a block of each. Equal vectors are one entry with their smallest ids, as many as a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bitmap_log2, has_bit, lean, repeated_bits, stage, table

#: Bytes of vectors (at four a component) that the index is fitted on, at most: 131,072 vectors of 64 components.
SAMPLE_BYTES = 32 << 20
#: Queries that the ratio is measured on, at most.
PROBES = 256
#: Vectors a list is planned for, before replication; sampled vectors a centroid is made of, at least.
LIST, MADE_OF = 256, 8
#: Rows of either side in a cell.
CELL = 16_384
#: Edges of a centroid in the graph.
EDGES = 24
#: Lists that a query searches first.
FIRST = 4


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors to be found, with the component that makes all of them as long as the longest one, at length 1."""
    y = x / longest
    return np.concatenate((y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))[:, None]), axis=1).astype(np.float32)


def asking(q: np.ndarray) -> np.ndarray:
    """Queries, at length 1 and with 0 in the additional component."""
    return np.concatenate((q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))), axis=1).astype(np.float32)


def _split(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of ``parts`` clusters: k-means in which a cluster above its share costs more."""
    centres = x[rng.choice(len(x), parts, replace=False)]
    counts, share = np.full(parts, len(x) / parts), len(x) / parts
    for _ in range(8):
        d = (centres * centres).sum(1) - 2 * (x @ centres.T)
        spread = max(float(np.ptp(d, axis=1).mean()), 1e-12)
        label = np.argmin(d + 0.1 * spread * (counts / share - 1), axis=1)
        counts = np.bincount(label, minlength=parts)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return label


def balanced_centroids(x: np.ndarray, lists: int, fan: int = 16, seed: int = 1) -> np.ndarray:
    """``lists`` centroids at most: clusters are split ``fan`` ways, each into lists by its share of the rows, until one is left."""
    rng, out, todo = np.random.default_rng(seed), [], [(x, lists)]
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) <= n:
            out.append(rows.mean(axis=0))
            continue
        label = _split(rows, min(fan, n), rng)
        parts = [rows[label == c] for c in range(min(fan, n))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # all rows are alike
            out.append(rows.mean(axis=0))
            continue
        todo += [(p, max(1, round(n * len(p) / len(rows)))) for p in parts]
    return np.unique(np.array(out, dtype=np.float32), axis=0)


@dataclass
class Index:
    """Centroids and their graph; ``search`` finds the nearest centroids of many vectors at once."""

    centroids: np.ndarray
    edges: np.ndarray
    pivots: np.ndarray
    longest: float  # the greatest length of a vector

    @classmethod
    def of(cls, centroids: np.ndarray, longest: float) -> Index:
        n, edges = len(centroids), []
        squares = (centroids * centroids).sum(1)
        for a in range(0, n, 512):
            d = squares[a : a + 512, None] - 2 * (centroids[a : a + 512] @ centroids.T) + squares
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near = np.argsort(d, axis=1)[:, : 4 * EDGES]
            edges += [cls._spread(centroids, a + i, near[i][np.isfinite(d[i][near[i]])], d[i]) for i in range(len(d))]
        reverse: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(edges):
            for j in row:
                reverse[j].append(i)
        table_ = np.repeat(np.arange(n, dtype=np.int32)[:, None], 2 * EDGES, axis=1)  # padded by the node itself
        for i in range(n):
            both = list(dict.fromkeys([*edges[i], *reverse[i]]))[: 2 * EDGES]
            table_[i, : len(both)] = both
        pivots = np.random.default_rng(2).permutation(n)[: max(32, int(4 * n**0.5))]
        return cls(centroids, table_, pivots, longest)

    @staticmethod
    def _spread(centroids: np.ndarray, i: int, near: np.ndarray, d: np.ndarray) -> list[int]:
        """The nearest centroids, without those that are nearer to one already taken than to i; the nearest others fill up."""
        taken: list[int] = []
        for j in near.tolist():
            if len(taken) == EDGES:
                break
            if not taken or ((centroids[taken] - centroids[j]) ** 2).sum(1).min() > d[j]:
                taken.append(j)
        rest = [j for j in near.tolist() if j not in taken]
        return taken + rest[: EDGES - len(taken)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To all centroids; for bounded numbers of vectors."""
        c = self.centroids
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the ``width`` nearest that the graph leads to, nearest first."""
        ids, far = [], []
        for a in range(0, len(x), 512):
            i, d = self._search(x[a : a + 512], min(width, len(self.centroids)))
            ids.append(i)
            far.append(d)
        return np.concatenate(ids), np.concatenate(far)

    def _search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        c, n = self.centroids, len(x)
        squares, rows = (c * c).sum(1), np.arange(n)[:, None]
        own = (x * x).sum(1)[:, None]
        seen = np.zeros((n, len(c) + 1), dtype=bool)  # the last column stands for no centroid
        seen[:, self.pivots] = True
        ids = np.repeat(self.pivots[None], n, axis=0)
        d = squares[self.pivots] - 2 * (x @ c[self.pivots].T)
        if ids.shape[1] < width:
            pad = width - ids.shape[1]
            ids, d = np.concatenate((ids, np.full((n, pad), len(c))), axis=1), np.concatenate((d, np.full((n, pad), np.inf, dtype=d.dtype)), axis=1)
        best = np.argsort(d, axis=1)[:, :width]
        ids, d = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)
        done = ids == len(c)
        while not done.all():
            # the four nearest that weren't followed yet, of each vector
            order = np.argsort(np.where(done, np.inf, d), axis=1, kind="stable")[:, :4]
            active = ~np.take_along_axis(done, order, 1)
            np.put_along_axis(done, order, True, 1)
            follow = np.take_along_axis(ids, order, 1)
            new = self.edges[np.minimum(follow, len(c) - 1)]
            new = np.where(active[:, :, None], new, len(c)).reshape(n, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = len(c)
            new[seen[rows, new]] = len(c)
            if (new == len(c)).all():
                continue
            seen[rows, new] = True
            keep = np.sort(new, axis=1)[:, : int((new < len(c)).sum(1).max())]
            at = np.minimum(keep, len(c) - 1)
            fresh = squares[at] - 2 * np.einsum("nd,nkd->nk", x, c[at])
            fresh = np.where(keep == len(c), np.inf, fresh)
            ids, d = np.concatenate((ids, keep), axis=1), np.concatenate((d, fresh), axis=1)
            done = np.concatenate((done, keep == len(c)), axis=1)
            best = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d, done = (np.take_along_axis(z, best, 1) for z in (ids, d, done))
        return ids, np.sqrt(np.maximum(0.0, d + own))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id, and a vector without null and non-finite components that isn't zero."""
    v = F.col("vec")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vec")).filter(F.col("id").isNotNull() & v.isNotNull() & good)


def distinct_vectors(rows: DataFrame, n: int, most: int) -> DataFrame:
    """(ids, vec): one row a vector, with its ``most`` smallest ids in order. Only vectors that occur again, by a bitmap, are shuffled."""
    log2 = bitmap_log2(n)
    keyed = rows.withColumn("__key", F.xxhash64("vec"))
    again = stage(repeated_bits(keyed, "__key", log2), "neighbours-bits")
    tested = has_bit(keyed, again, "__key", "__again", log2)
    alone = tested.filter("not __again").select(F.array("id").alias("ids"), "vec")
    several = tested.filter("__again").select("id", "vec").distinct()
    several = several.withColumn("__n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("__n") <= most)
    return alone.unionByName(several.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "vec"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; all lists are of one length."""
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def post(entries: DataFrame, index: Index, replicas: int, closure: float) -> DataFrame:
    """(list, first, ids, vec): an entry in its nearest list (``first``), and in up to ``replicas`` - 1 more within ``closure`` times that distance."""
    kinds = dict(entries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lists, d = index.search(lifted(matrix(batch.column("vec")), index.longest), max(16, 4 * replicas))
                take = d[:, :replicas] <= closure * d[:, :1]
                take[:, 0] = True
                take &= lists[:, :replicas] < len(index.centroids)
                row, rank = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, rank], pa.int32()), pa.array(rank == 0), batch.column("ids").take(pa.array(row)), batch.column("vec").take(pa.array(row))], names=["list", "first", "ids", "vec"])

    return lean(entries).mapInArrow(run, f"list int, first boolean, ids {kinds['ids']}, vec {kinds['vec']}")


def best_of(q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the ``k`` largest inner products of each query, smaller names first among equals; by query, best first.

    With ``bound``, a number per query, only products of about that size or more.

    The products of the whole block only preselect; each score is then summed row by row, the same way wherever the pair is met.
    """
    found = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        if bound is not None:
            least = np.maximum(least, bound[a : a + 256])
        i, j = np.nonzero(s >= (least - 1e-9 * np.maximum(1.0, np.abs(least)))[:, None])
        score = (q[a + i] * x[j]).sum(axis=1)
        order = np.lexsort((names[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        found.append((a + i[keep], j[keep], score[keep]))
    return tuple(np.concatenate(z) for z in zip(*found))  # type: ignore[return-value]


def measured_ratio(posted: DataFrame, index: Index, probes: list[tuple[int, np.ndarray]], k: int, replicas: int, recall: float) -> tuple[float, float, int]:
    """(ratio, least distance it is taken of, width): what reaches ``recall`` of the true neighbours of the probes, over all rows."""
    ids, q = np.array([i for i, _ in probes]), np.array([v for _, v in probes])
    d = index.distances(asking(q)).astype(np.float64)
    nearest = d.min(axis=1)
    typical = float(np.median(nearest))
    base = np.maximum(nearest, typical)
    most = (k + 1) * replicas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            x, lists = matrix(batch.column("vec")), batch.column("list").to_numpy()
            names = np.array([v[0] for v in batch.column("ids").to_pylist()], dtype=np.int64)
            i, j, score = best_of(q, x, names, most)
            now = (i, names[j], score, d[i, lists[j]] / base[i])
            held = now if held is None else tuple(np.concatenate(z) for z in zip(held, now))
            order = np.lexsort((held[1], -held[2], held[0]))
            held = tuple(z[order] for z in held)
            keep = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < most
            held = tuple(z[keep] for z in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), *map(pa.array, held[1:])], names=["probe", "id", "score", "ratio"])

    each = lean(posted.select("list", "ids", "vec")).mapInArrow(run, "probe long, id long, score double, ratio double")
    each = each.groupBy("probe", "id").agg(F.max("score").alias("score"), F.min("ratio").alias("ratio")).filter("probe != id")
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k)
    ratio = top.agg(F.percentile("ratio", recall)).first()[0]
    ratio = 1.0 if ratio is None else max(1.0, float(ratio))
    width = int((d <= (ratio * base)[:, None]).sum(axis=1).max())
    return ratio, typical, min(len(index.centroids), width + width // 4 + 8)


def ask(queries: DataFrame, index: Index, ratio: float, typical: float, width: int, sizes: np.ndarray, k: int, first: bool) -> DataFrame:
    """(list, query_id, bound, vec): a query in each list that it searches, the nearest ones or the others.

    ``queries`` (id, bound, vec); ``sizes``: ids whose first list this is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = asking(matrix(batch.column("vec")))
            lists, d = index.search(q, width)
            held = np.concatenate((sizes, [0]))[lists]
            short = np.flatnonzero(held.sum(axis=1) <= k)  # too few ids in all of them: such queries search every list at first
            before = np.cumsum(held, axis=1) - held
            near = np.arange(lists.shape[1])[None] < FIRST
            near = near | (before <= k)
            take = near if first else ~near & (d <= ratio * np.maximum(d[:, :1], typical))
            take &= lists < len(index.centroids)
            take[short] = False
            row, rank = np.nonzero(take)
            short = short if first else short[:0]
            row, lists = np.concatenate((row, np.repeat(short, len(sizes)))), np.concatenate((lists[row, rank], np.tile(np.arange(len(sizes)), len(short))))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(batch.column(c).take(pa.array(row)) for c in ("id", "bound", "vec"))], names=["list", "query_id", "bound", "vec"])

    return lean(queries).mapInArrow(run, f"list int, query_id long, bound double, vec {dict(queries.dtypes)['vec']}")


def search_lists(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each list, for each query that searches it, the ``k`` best that reach the query's bound."""
    cells = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    dealt = stage(cells(posted, "here").join(cells(asked, "there"), "list"), "neighbours-cells")  # a row a list: bounded by the sample
    entries = posted.join(F.broadcast(dealt), "list").withColumn("slot", F.pmod(F.xxhash64(F.col("ids")[0]), "here"))
    entries = entries.select("list", "slot", F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias("turn"), "ids", "vec")
    asked = asked.join(F.broadcast(dealt), "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), "there").cast("int"))
    asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here").cast("long") - 1)).alias("slot"), "turn", "query_id", "bound", "vec")
    key = ["list", "slot", "turn"]

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        if len(queries) and len(members):
            ids = members["ids"].combine_chunks()
            counts, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            starts = np.cumsum(counts) - counts
            asks, bound = queries["query_id"].to_numpy(), queries["bound"].to_numpy()
            i, j, score = best_of(matrix(queries["vec"]), matrix(members["vec"]), flat[starts], k + 1, bound)
            n = counts[j]
            vec_id = flat[np.repeat(starts[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            i, score = np.repeat(i, n), np.repeat(score, n)
            keep = (vec_id != asks[i]) & (score >= bound[i])
            i, vec_id, score = i[keep], vec_id[keep], score[keep]
            order = np.lexsort((vec_id, -score, i))
            i, vec_id, score = i[order], vec_id[order], score[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out = [asks[i[keep]], vec_id[keep], score[keep]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return asked.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best, each id once."""
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", replicas: int = 4, closure: float = 1.2, recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (over ``id``) the ``k`` rows found with the largest inner product.

    Nearest first, ties to the smaller id; ``score`` is the inner product in doubles. Rows with the query's own id aren't candidates; where there are
    fewer than ``k`` candidates, all are returned. Rows take no part whose id or vector is null, or whose vector is empty, zero
    or holds null or non-finite components, or has another length than most vectors (of lengths equally frequent, the smallest counts). Repeated rows count once;
    a query id with several vectors asks with the smallest one, a candidate id with several is listed once, by its best. Other columns are ignored,
    so their names can't clash. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    kinds = rows.select(F.size("vec").alias("dim"), length.alias("length")).groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    kind = kinds.orderBy(F.desc("n"), "dim").first()
    if kind is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vec") == kind["dim"])
    entries = stage(distinct_vectors(rows, kind["n"], k + 1), "neighbours-entries")
    queries = stage(rows.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec")), "neighbours-queries")
    n, n_queries = entries.count(), queries.count()

    def some(df: DataFrame, of: int, most: int, by: str) -> DataFrame:
        """About ``most`` rows at most, by a hash."""
        return df.filter(F.pmod(F.xxhash64(by), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(of, 1)))).limit(2 * most)

    most = max(1024, SAMPLE_BYTES // (4 * kind["dim"]))
    sample = matrix(some(entries.select("vec", "ids"), n, most, "ids").select("vec").toArrow()["vec"])
    lists = max(1, min(n // LIST, len(sample) // MADE_OF))
    index = Index.of(balanced_centroids(lifted(sample, kind["longest"]), lists), kind["longest"])
    posted = stage(post(entries, index, replicas, closure), "neighbours-lists")
    probes = [(r.id, np.array(r.vec, dtype=np.float64)) for r in some(queries, n_queries, PROBES, "id").collect()]
    ratio, typical, width = measured_ratio(posted, index, probes, k, replicas, recall) if probes else (1.0, 0.0, len(index.centroids))
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for name, size in posted.filter("first").groupBy("list").agg(F.sum(F.size("ids"))).collect():  # a row a list
        sizes[name] = size
    unbounded = float("-inf")
    how = (index, ratio, typical, width, sizes, k)
    asked = stage(ask(queries.select("id", F.lit(unbounded).alias("bound"), "vec"), *how, first=True), "neighbours-asked")
    near = stage(top(search_lists(posted, asked, k), k), "neighbours-near")
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = queries.join(bounds, "id", "left").select("id", F.coalesce("bound", F.lit(unbounded)).alias("bound"), "vec")
    rest = stage(ask(bounded, *how, first=False), "neighbours-rest")
    return top(near.drop("rank").unionByName(search_lists(posted, rest, k)), k)


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
