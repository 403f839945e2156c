"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are halved; each half is quantised by its own k-means, fitted on a bounded sample (about SAMPLE rows, by a
hash of id and vector). A cell is a pair of centroids; every row is indexed. A query walks the pairs by summed distance
with a heap until the cells seen hold a share of all rows. That share is calibrated, the same way at every size: on PROBES
of the sample's rows, the least share whose cells hold the share TARGET of their true neighbours in the sample. The cells
of one centroid of the first half are an inverted list, in order of the other centroid; a query goes to each list of
which it has seen cells, with a mark for each. Lists of many rows are dealt into blocks of about BLOCK rows, and queries
into groups of about GROUP, so no task holds more of either; each block returns only its nearest rows for each query. The order and the score come from the cosine in double
precision on the original vectors.

Vectors that are null, zero, of another length than the sample's commonest, or hold null or non-finite components take
no part; nor do null ids. Rows that share an id are never neighbours of one another, and of several the nearest counts;
a repeated query row is one query, queries of one id with other vectors are ranked each by itself. Ties go to the
smaller id. No or too few candidates: fewer rows. Other columns are not looked at. Empty tables: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import stored

SAMPLE, BLOCK, GROUP = 20_000, 4096, 4096
PROBES, TARGET = 400, 0.95
#: Rows of a cell, while a half has at most MOST centroids.
CELL, MOST = 4, 1024


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = rows.select(F.col(id_col).cast("bigint").alias("id"), vec).where("id is not null and vec is not null")
    return out.where(F.forall("vec", good) & F.exists("vec", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    own = np.unique(x, axis=0)
    c = own[rng.permutation(len(own))[:k]]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    def __init__(self, sample: np.ndarray, k: int):
        x = unit(sample)
        self.dim, self.half = x.shape[1], x.shape[1] // 2
        self.centres = kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(x)
        return tuple(((h * h).sum(axis=1)[:, None] - 2 * h @ c.T + (c * c).sum(axis=1)) for h, c in zip((x[:, : self.half], x[:, self.half :]), self.centres, strict=True))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.centres[1]) + b.argmin(axis=1)

    def share(self, sample: np.ndarray, k: int, probes: int = PROBES, target: float = TARGET) -> float:
        """Of all rows, those that a walk must see to meet the share `target` of the k nearest rows, over probes of the sample."""
        x = unit(sample)
        asked = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
        cell = self.cells(sample)
        rows = np.bincount(cell, minlength=len(self.centres[0]) * len(self.centres[1]))
        count = {int(c): int(rows[c]) for c in np.nonzero(rows)[0]}
        near, needed = x[asked] @ x.T, []
        near[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
        a, b = self.distances(sample[asked])
        for i in range(len(asked)):
            order = np.array(self.walk(a[i], b[i], count, len(x)))
            seen = np.empty(len(rows))
            seen[order] = np.cumsum(rows[order])
            needed += seen[cell[best[i]]].tolist()
        return float(np.quantile(needed, target) / len(x))

    def walk(self, a: np.ndarray, b: np.ndarray, count: dict[int, int], wanted: int) -> list[int]:
        """Cells with rows, by summed distance of the two halves, until they hold the wanted rows."""
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, out, total = [(a[i_of[0]] + b[j_of[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and total < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(i_of[i]) * len(b) + int(j_of[j])
            if n := count.get(cell, 0):
                out.append(cell)
                total += n
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (a[i_of[p]] + b[j_of[q]], p, q))
        return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by cosine. share: of all rows, those seen; calibrated if not given."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    every = usable(rows, id_col, vec_col)
    sizes = {r["size"]: r["n"] for r in every.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    ((dim, total),) = sizes.items()
    fit = lambda df: df.where(F.size("vec") == dim)
    asked = fit(usable(queries, id_col, vec_col)).distinct()
    every = fit(every)
    if dim < 2:  # one component has no halves
        dim, widen = 2, lambda df: df.select("id", F.concat("vec", F.array(F.lit(0.0))).alias("vec"))
        every, asked = widen(every), widen(asked)
    key = F.xxhash64("id", "vec")
    # about SAMPLE rows, of repeated ones all or none
    some = every.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))).distinct() if total > SAMPLE else every.distinct()
    picked = some.orderBy(key, "id").select("vec").toArrow().column("vec")
    if not len(picked):
        picked = every.limit(1).select("vec").toArrow().column("vec")
    sample = matrix(picked, dim)
    index = Index(sample, int(np.clip((total / CELL) ** 0.5, 1, MOST)))
    share = index.share(sample, k, target=target) if share is None else share
    known = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.cells(matrix(batch.column(1), dim)), pa.int32())], ["id", "vec", "cell"])

    filed = stored(every.mapInArrow(assign, "id bigint, vec array<double>, cell int"))
    count = {r.cell: r.n for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pair of centroids at most
    counts = spark.sparkContext.broadcast(count)
    width, lists = len(index.centres[1]), {}
    for c, n in count.items():
        lists[c // width] = lists.get(c // width, 0) + n
    lists = {i: -(-n // BLOCK) for i, n in lists.items()}  # blocks of each list
    wanted = int(np.ceil(share * total)) + 1

    asked = asked.withColumn("query", F.xxhash64("id", "vec"))
    n_groups = max(1, -(-asked.count() // GROUP))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = known.value.distances(matrix(batch.column(1), dim))
            row, list_, block, marks = [], [], [], []
            for i in range(batch.num_rows):
                seen = np.zeros((len(known.value.centres[0]), width), bool)
                seen.ravel()[known.value.walk(a[i], b[i], counts.value, wanted)] = True
                for c in np.nonzero(seen.any(axis=1))[0].tolist():
                    row += [i] * lists[c]
                    list_ += [c] * lists[c]
                    block += range(lists[c])
                    marks += [np.packbits(seen[c]).tobytes()] * lists[c]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(list_, pa.int32()), pa.array(block, pa.int32()), pa.array(marks, pa.binary())], ["id", "vec", "query", "part", "list", "block", "marks"])

    # few rows, but a walk over the cells for each: they go to all cores
    asked = asked.withColumn("part", F.pmod("query", F.lit(n_groups)).cast("int")).repartition(max(n_groups, spark.sparkContext.defaultParallelism), "query")
    visits = asked.mapInArrow(visit, "id bigint, vec array<double>, query bigint, part int, list int, block int, marks binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by turns, so that rows of one id spread too; the order of a written table's rows does not change
        at = TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(2).to_numpy() // width
            n = np.array([lists[c] for c in own.tolist()], np.int64)
            turn = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(turn % np.maximum(n, 1), pa.int32())], ["id", "vec", "cell", "list", "block"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("vec"), dim), matrix(right.column("vec"), dim)
            ids, asking, query = left.column("id").to_numpy(), right.column("id").to_numpy(), right.column("query").to_numpy()
            _, first = np.unique(np.column_stack((ids.view(np.float64), x)).view(np.uint64), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (None, np.arange(len(ids)))
            x, ids, column = x[first], ids[first], left.column("cell").to_numpy()[first] % width  # of repeated rows one
            seen = np.unpackbits(np.frombuffer(b"".join(right.column("marks").to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, :width].astype(bool)
            again = len(ids) - len(np.unique(ids))  # rows of an id besides its first
            x_unit = unit(x)
            norm = np.sqrt((x * x).sum(axis=1))
            for a in range(0, len(q), 256):
                rough = unit(q[a : a + 256]) @ x_unit.T
                rough[(asking[a : a + 256, None] == ids[None, :]) | ~seen[a : a + 256, column]] = -np.inf
                last = max(0, rough.shape[1] - k - again)
                edge = np.partition(rough, last, axis=1)[:, last] - 1e-9
                for i, row in enumerate(rough):
                    at = np.nonzero((row >= edge[i]) & (row > -np.inf))[0]
                    v = q[a + i]
                    exact = (x[at] * v).sum(axis=1) / (norm[at] * np.sqrt((v * v).sum()))
                    best = np.lexsort((ids[at], -exact))
                    if again:  # the nearest row of each id
                        best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
                    best = best[:k]
                    out.append((np.full(len(best), asking[a + i]), np.full(len(best), query[a + i]), ids[at][best], exact[best]))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table({"query_id": pa.array(joined[0], pa.int64()), "query": pa.array(joined[1], pa.int64()), "vec_id": pa.array(joined[2], pa.int64()), "score": pa.array(joined[3], pa.float64())})

    dealt = filed.mapInArrow(deal, "id bigint, vec array<double>, cell int, list int, block int").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    by = ["list", "block", "part"]
    found = dealt.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(rerank, "query_id bigint, query bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
