"""Exact top-k search by inner product with a pivot table.

Distances from every vector to a set of pivots are computed once.  For a query, the
triangle inequality over all pivots gives a lower bound on its distance to a vector, and
with both norms an upper bound on their inner product.  Vectors are evaluated in the
order of their bounds until the next bound is below the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import with_rank
from lodestone.scratch import materialize

SCALE = 1024
#: Pivots are spread over a sample of this many vectors, taken by hash; the sample only steers how early a search stops.
PIVOTS, SAMPLE = 32, 512
#: Vectors in a block of the table, and queries that are broadcast at a time.
BLOCK, QUERIES = 2048, 4096
#: Vectors evaluated between two looks at the k-th best score.
STEP = 64
#: Whole numbers below this are exact in double arithmetic.
EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` with v = floor(1024 * x) as doubles; rows with a null id, vector or component, or one whose product with 1024 isn't finite, are left out."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    # floor() gives a long, which large doubles would overflow; from 2**53 on they are whole already
    floor = F.transform(v, lambda x: F.when(F.abs(x * SCALE) < EXACT, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("v"))


def matrix(vectors: list[list[float]], dims: int = 0) -> np.ndarray:
    """Rows padded with zeros to one width, which changes no inner product."""
    out = np.zeros((len(vectors), max([dims, *map(len, vectors)])))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def widened(a: np.ndarray, dims: int) -> np.ndarray:
    return a if a.shape[1] >= dims else np.pad(a, ((0, 0), (0, dims - a.shape[1])))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dims = max(a.shape[1], b.shape[1])
    a, b = widened(a, dims), widened(b, dims)
    with np.errstate(over="ignore", invalid="ignore"):  # beyond doubles the bound is void, and search() then evaluates
        return _roots(a, b)


def _roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: in doubles where no sum can pass 2**53, else in whole numbers, held within a long."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(len(q), 1) < EXACT:
        return (x @ q).astype(np.int64)
    own = [int(b) for b in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, own)), -(2**63)), 2**63 - 1) for row in x.tolist()], np.int64)


class Block:
    """A block of vectors with their norms and distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray):
        self.ids, self.x, self.table = ids, x, table
        self.norms = (x * x).sum(1)


class Search:
    """Best k of the blocks seen so far for each of a set of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.pivots = pivots
        self.norms = (q * q).sum(1)
        self.table = distances(q, pivots)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def see(self, block: Block) -> None:
        x, dims = block.x, max(block.x.shape[1], self.q.shape[1])
        x, q = widened(x, dims), widened(self.q, dims)
        for k in range(len(self.ids)):
            gap = np.zeros(len(x))
            for p in range(self.table.shape[1]):
                np.maximum(gap, np.abs(block.table[:, p] - self.table[k, p]), out=gap)
            size = block.norms + self.norms[k]
            # the slack covers the rounding of norms and distances
            bound = np.nan_to_num((size - gap * gap) / 2 + 1e-9 * size + 1, nan=np.inf)
            bound[block.ids == self.ids[k]] = -np.inf
            self.evaluate(k, x, q[k], block.ids, bound)

    def evaluate(self, k: int, x: np.ndarray, q: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> None:
        scores, found = self.best[k]
        floor = scores[-1] if len(scores) == self.k else -np.inf
        able = np.flatnonzero(bound >= floor) if floor > -np.inf else np.flatnonzero(bound > -np.inf)
        able = able[np.argsort(-bound[able], kind="stable")]
        for at in range(0, len(able), STEP):
            some = able[at : at + STEP]
            if len(scores) == self.k and bound[some[0]] < scores[-1]:
                break
            scores, found = np.concatenate([scores, dot(x[some], q)]), np.concatenate([found, ids[some]])
            order = np.lexsort((found, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[: self.k]
            scores, found = scores[order], found[order]
        self.best[k] = (scores, found)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of vectors, packed, with their distances to the pivots: ``(n, dims, ids, x, dists)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), BLOCK):
                x = matrix(rows[at : at + BLOCK])
                packed = [np.array(ids[at : at + BLOCK], np.int64).tobytes(), x.tobytes(), distances(x, pivots).tobytes()]
                columns = [pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), *(pa.array([b], pa.binary()) for b in packed)]
                yield pa.RecordBatch.from_arrays(columns, ["n", "dims", "ids", "x", "dists"])

    return vectors.mapInArrow(run, "n int, dims int, ids binary, x binary, dists binary")


def search(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best candidates, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by ``every``; candidates are all vectors
    with another id.  Queries are broadcast in blocks of at most QUERIES; each partition
    of the pivot table searches its own blocks and hands on k rows a query, which are
    ranked once more.  Vectors of unequal length are padded with zeros.  Rows of the same
    id are one query if equal, and else a query with a list of its own each.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = materialize(whole_vectors(df, id_col, vector_col), "vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    pivots = spread(matrix([r["v"] for r in sample]), PIVOTS)
    table = materialize(pivot_table(vectors, pivots), "pivots")
    queries = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = materialize(with_rank(queries, ["vec_id", "v"], "r"), "queries")
    n = queries.count()
    schema = "r long, query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for at in range(0, n, QUERIES):
        rows = queries.where((F.col("r") >= at) & (F.col("r") < at + QUERIES)).collect()  # bounded by QUERIES
        block = spark.sparkContext.broadcast(([r["r"] for r in rows], np.array([r["vec_id"] for r in rows], np.int64), matrix([r["v"] for r in rows], pivots.shape[1]), pivots))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ranks, ids, q, marks = block.value
            own = Search(ids, q, marks, k)
            for batch in batches:
                for n, dims, raw_ids, raw_x, raw_d in zip(*[batch.column(c).to_pylist() for c in ("n", "dims", "ids", "x", "dists")]):
                    own.see(Block(np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_x).reshape(n, dims), np.frombuffer(raw_d).reshape(n, len(marks))))
            for r, query, (scores, hits) in zip(ranks, ids.tolist(), own.best):
                if n := len(hits):
                    yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int64()), pa.array([query] * n, pa.int64()), pa.array(hits), pa.array(scores)], ["r", "query_id", "vec_id", "score"])

        found = found.unionByName(table.mapInArrow(run, schema))
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
