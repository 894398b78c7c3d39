"""Operator 7: nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own `CENTROIDS` centroids
(k-means on a bounded sample of `SAMPLE` vectors); a vector's cell is its pair
of centroids. A query walks the pairs by rising sum of its distances to the two
centroids, with a heap over the two sorted distance lists, until the cells it
has visited hold the wanted share of all vectors; every vector of those cells
is then ranked by its exact distance in double precision.

The share is measured, not guessed: for `PROBES` sample queries the true
neighbours are found by one pass over all vectors, and the share is the
`RECALL` quantile of what a walk needs to reach each of them.

Equal vectors are folded first, with the `k + 1` smallest ids of each, which is
all that a query can return. A cell is cut into blocks of about `BLOCK` vectors
and its queries into batches, so no cell is one task's work; blocks meet
batches by a join on the cell, and each task keeps only the best `k` per query.
What is gathered or broadcast is bounded by the parameters: codebooks, one
count per cell, the probes.

Cases: vectors that are null, all zero or hold null or non-finite components
take no part, nor do those, as candidates or queries, whose length is not the most frequent one of the
candidates (ties: the longest); a null vec_id is no query and no candidate; rows
that repeat a vec_id and its vector are one candidate or one query, other rows with
one vec_id are one each, and none is a candidate of its own query id; fewer than k
candidates give fewer rows; an empty table gives none.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, drawn, share, staged, table

CENTROIDS = 32
SAMPLE = 20_000
ROUNDS = 10
PROBES = 64
RECALL = 0.97
BLOCK = 2048
K = 10
KEEP = 1 << 20  # results held by a task before they are passed on


def usable(df: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v), v in doubles, of the rows that take part, each pair once; `length` None is the most frequent one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                     & F.exists("embedding", lambda x: x != 0))
    if length is None:
        usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        length = usual["n"] if usual else 0
    return rows.filter(F.size("embedding") == length).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).distinct()


def folded(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: v and the k + 1 smallest ids that have it."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return (rows.withColumn("place", place).filter(F.col("place") <= k + 1)
            .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, k, seed) for seed, part in enumerate(self.halves(sample))]
        self.width = len(self.books[1])

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.half], x[:, self.half:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(part, book) for part, book in zip(self.halves(x), self.books))
        return a * self.width + b

    def walk(self, q: np.ndarray):
        """Cells by rising summed distance: the multi-sequence walk over both sorted lists."""
        lists = [((book - part[0]) ** 2).sum(axis=1) for part, book in zip(self.halves(q[None]), self.books)]
        order = [np.argsort(d, kind="stable") for d in lists]
        first, second = (d[o].tolist() for d, o in zip(lists, order))
        heap, seen = [(first[0] + second[0], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(order[0][i]) * self.width + int(order[1][j])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(first) and b < len(second) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (first[a] + second[b], a, b))


def measured_share(index: DataFrame, probes: np.ndarray, books: Codebooks, counts: np.ndarray, k: int) -> float:
    """The share of all vectors that a walk must visit to meet `RECALL` of the probes' true neighbours."""
    shared = share(index.sparkSession, probes)

    def run(batches: Batches) -> Batches:
        q = shared()
        best = [[] for _ in q]
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            x = matrix(batch.column("v"))
            for a in range(0, len(x), 4096):
                part = x[a:a + 4096]
                d = (part ** 2).sum(axis=1) - 2 * q @ part.T
                top = np.argpartition(d, min(k, len(part) - 1), axis=1)[:, :k + 1]
                for i, row in enumerate(top):
                    best[i] = heapq.nsmallest(k + 1, best[i] + [(d[i, j], int(cells[a + j])) for j in row])
        rows = [(i, float(d), c) for i, found in enumerate(best) for d, c in found]
        yield pa.RecordBatch.from_pydict({"probe": pa.array([r[0] for r in rows], pa.int32()),
                                          "d": pa.array([r[1] for r in rows], pa.float64()),
                                          "cell": pa.array([r[2] for r in rows], pa.int32())})

    found = index.mapInArrow(run, "probe int, d double, cell int")
    place = F.row_number().over(Window.partitionBy("probe").orderBy("d"))
    rows = found.withColumn("place", place).filter(F.col("place").between(2, k + 1)).select("probe", "cell").collect()
    need = []
    upto = {}
    for i, q in enumerate(probes):
        walk = np.fromiter(books.walk(q), np.int64)
        upto[i] = dict(zip(walk.tolist(), (np.cumsum(counts[walk]) / max(1, counts.sum())).tolist()))
    need = [upto[r.probe][r.cell] for r in rows]
    return float(np.quantile(need, RECALL)) if need else 1.0


def search(base: DataFrame, queries: DataFrame, k: int = K, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every distinct row of `queries` its nearest distinct rows of
    `base` (vec_id, embedding)."""
    spark = base.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    vectors = staged(folded(usable(base), k), "vectors")
    sample = drawn(vectors.select("v"), SAMPLE, "v").collect()
    if not sample:
        return spark.createDataFrame([], empty)
    known = np.array([r.v for r in sample])
    books = Codebooks(known, centroids)
    shared = share(spark, books)

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            cells = shared().cells(matrix(batch.column("v"))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["v", "ids", "cell"])

    index = staged(vectors.mapInArrow(assign, "v array<double>, ids array<bigint>, cell int"), "cells")
    counts = np.zeros(len(books.books[0]) * books.width, np.int64)  # one number per cell: bounded
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    wanted = measured_share(index, known[:PROBES], books, counts, k)
    plan = share(spark, (books, counts, wanted))

    def visits(batches: Batches) -> Batches:
        books, counts, wanted = plan()
        stop = max(k + 1, int(np.ceil(wanted * counts.sum())))
        for batch in batches:
            x = matrix(batch.column("v"))
            for a in range(0, len(x), 64):  # a slice at a time: a walk has many cells
                ids, asks, cells, rows = [], [], [], []
                part = batch.slice(a, 64)
                for query, ask, q in zip(part.column("vec_id").to_pylist(), part.column("ask").to_pylist(), x[a:a + 64]):
                    got = 0
                    for cell in books.walk(q):
                        if counts[cell]:
                            ids.append(query)
                            asks.append(ask)
                            cells.append(cell)
                            rows.append(q.tobytes())
                            got += counts[cell]
                            if got >= stop:
                                break
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "query": pa.array(ids, pa.int64()),
                                                  "ask": pa.array(asks, pa.int64()), "q": pa.array(rows, pa.binary())})

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("ids").combine_chunks()
        return pa.table({"cell": rows.column("cell")[:1].cast(pa.int32()), "cut": rows.column("cut")[:1].cast(pa.int64()),
                         "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         "block": pa.array([matrix(rows.column("v").combine_chunks()).tobytes()], pa.binary())})

    def gather(rows: pa.Table) -> pa.Table:
        return pa.table({"cell": rows.column("cell")[:1].cast(pa.int32()),
                         "queries": pa.array([rows.column("query").to_pylist()], pa.list_(pa.int64())),
                         "asks": pa.array([rows.column("ask").to_pylist()], pa.list_(pa.int64())),
                         "qs": pa.array([b"".join(rows.column("q").to_pylist())], pa.binary())})

    # cells of many vectors or queries are cut by a hash into pieces of about BLOCK
    pieces = F.array(*[F.lit(int(max(1, -(-c // BLOCK)))).cast("long") for c in counts])
    cut = F.pmod(F.xxhash64("v"), F.element_at(pieces, F.col("cell") + 1))
    blocks = (index.withColumn("cut", cut).groupBy("cell", "cut")
              .applyInArrow(pack, "cell int, cut bigint, ids array<array<bigint>>, block binary"))
    # rows of one vec_id with different vectors are told apart by a staged number
    asked = staged(usable(queries, known.shape[1]).withColumn("ask", F.monotonically_increasing_id()), "queries")
    n_cuts = max(1, asked.count() // BLOCK)
    # each block of a cell is a key of its own, to which every batch of the cell goes
    batches_ = (asked.mapInArrow(visits, "cell int, query bigint, ask bigint, q binary")
                .withColumn("part", F.pmod(F.xxhash64("ask"), F.lit(n_cuts)))
                .groupBy("cell", "part").applyInArrow(gather, "cell int, queries array<bigint>, asks array<bigint>, qs binary")
                .withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(pieces, F.col("cell") + 1) - 1))))

    def rank(batches: Batches) -> Batches:
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(len(batch)):
                x = np.frombuffer(batch.column("block")[i].as_py(), np.float64)
                owners = batch.column("ids")[i].as_py()
                x = x.reshape(len(owners), -1)
                shared_by = np.array([len(o) > 1 for o in owners])
                first = np.array([o[0] for o in owners])
                queries = batch.column("queries")[i].as_py()
                qs = np.frombuffer(batch.column("qs")[i].as_py(), np.float64).reshape(len(queries), -1)
                for query, ask, q in zip(queries, batch.column("asks")[i].as_py(), qs):
                    # a vector of the query's id alone is no candidate and takes no candidate's place
                    d = np.where((first != query) | shared_by, np.sqrt(((x - q) ** 2).sum(axis=1)), np.inf)
                    top = np.argsort(d, kind="stable")[:k + 1] if len(d) <= 4 * k else np.argpartition(d, k + 1)[:k + 2]
                    edge = d[top].max()
                    if len(top) < len(d):  # vectors as far as the last one may have smaller ids
                        top = np.flatnonzero(d <= edge)
                    new = [(float(d[j]), v) for j in top for v in owners[j] if v != query]
                    best[query, ask] = heapq.nsmallest(k, best.get((query, ask), []) + new)
            if len(best) * k > KEEP:
                yield flush(best)
                best = {}
        yield flush(best)

    def flush(best: dict[tuple[int, int], list]) -> pa.RecordBatch:
        rows = [(q, v, d, ask) for (q, ask), found in best.items() for d, v in found]
        return pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in rows], pa.int64()),
                                           "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                                           "score": pa.array([r[2] for r in rows], pa.float64()),
                                           "ask": pa.array([r[3] for r in rows], pa.int64())})

    # Spark takes the batches to be as small as the staged queries and would broadcast them
    found = blocks.join(batches_.hint("merge"), ["cell", "cut"]).mapInArrow(rank, "query_id bigint, vec_id bigint, score double, ask bigint")
    place = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
