"""Exact top-k inner products by columnar branch and bound.

Queries and candidates are dealt into blocks of bounded size, and every block of
queries meets every block of candidates: a candidate travels once for each block
of queries, a query once for each block of candidates. In a meeting one group of
dimensions at a time is accumulated in a vertical layout. What the remaining
dimensions can add is bounded by the product of the remaining norms; a pair
whose bound lies under the query's k-th best score so far, or under its k-th
best lower bound, is dropped. While many pairs live, candidates that none of
the queries needs are compacted away; once few do, only the pairs that live are
carried on. The k best of each meeting are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 8_192
GROUP = 16
#: Share of living pairs from which on pairs are carried in place of whole columns.
SPARSE = 0.1
#: Bytes of queries and of candidates, as 64-bit integers, that meet in one task, and those below which a block is not split further.
QUERY_BYTES, CANDIDATE_BYTES, LEAST_BYTES = 16 << 20, 64 << 20, 1 << 20
EXACT = 2.0**53


def integers(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and vec (array<long>): floor(scale * x) of each component.

    Rows whose id or vector is null, or that hold a null or non-finite
    component, are left out; repeated rows count once.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).alias("vec_id"), whole.alias("vec")).distinct()


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of each vector from each dimension on; the last column is 0."""
    whole = np.zeros((len(vectors), vectors.shape[1] + 1))
    whole[:, :-1] = np.sqrt(np.cumsum(vectors[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1])
    return whole


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query index, candidate index and score of the pairs that may be among the k best, by query; ids equal to the query's are left out.

    floor: for each query a score that k other candidates reach, or -inf.
    """
    dims = queries.shape[1]
    rest_q, rest_c = rest_norms(queries), rest_norms(block)
    # a little more than the exact product, so that rounding cannot hide a pair; other types than doubles hold integers that a double does not
    loose = 0.0 if block.dtype == np.float64 else 1e-12
    slack = lambda q, c, at: rest_q[q, at] * rest_c[c, at] * (1 + 1e-9) + loose * rest_q[q, 0] * rest_c[c, 0] + 1
    alive, partial, stop, least = np.arange(len(ids)), np.zeros((len(queries), len(ids)), queries.dtype), 0, floor
    rows = np.arange(len(queries))[:, None]
    own = query_ids[:, None] == ids[None, :]
    keep = ~own
    while stop < dims:
        start, stop = stop, min(dims, stop + GROUP)
        partial += queries[:, start:stop] @ block[alive, start:stop].T
        bound = slack(rows, alive[None, :], stop)
        least = floor
        if len(alive) >= k and np.isneginf(floor).any():
            low = np.where(own[:, alive], -np.inf, partial.astype(np.float64) - bound)
            least = np.maximum(floor, np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k])
        keep = ((partial + bound) >= least[:, None]) & ~own[:, alive]
        if keep.mean() < SPARSE:
            break
        some = keep.any(axis=0)
        if not some.all():
            alive, partial, keep = alive[some], partial[:, some], keep[:, some]
    q, column = np.nonzero(keep)
    c, score = alive[column], partial[q, column]
    while stop < dims:
        start, stop = stop, min(dims, stop + GROUP)
        score = score + (queries[q, start:stop] * block[c, start:stop]).sum(axis=1)
        live = score + slack(q, c, stop) >= least[q]
        q, c, score = q[live], c[live], score[live]
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], c[place < k], score[place < k]


def best_of_blocks(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query index, candidate index and score, block after block; a block's k-th best scores bound the next."""
    floor, scores = np.full(len(queries), -np.inf), np.full((len(queries), k), -np.inf)
    for start in range(0, len(ids), CANDIDATE_BLOCK):
        part = slice(start, start + CANDIDATE_BLOCK)
        q, c, score = best_of_block(queries, query_ids, vectors[part], ids[part], k, floor)
        yield q, c + start, score
        found = np.full((len(queries), k), -np.inf)
        found[q, np.arange(len(q)) - np.searchsorted(q, q)] = score
        scores = np.sort(np.concatenate([scores, found], axis=1), axis=1)[:, -k:]
        floor = scores[:, 0]


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k highest integer inner products of each query with the other vectors.

    Both sides are vec_id and vec as ``integers`` returns them. Returns
    query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id;
    all candidates, if there are fewer than k. A vector meets those of its own
    length only, and never one with its own id. An empty side gives no rows.
    """
    blocks = [dealt.first() for dealt in (_bytes(queries), _bytes(vectors))]  # two rows of one number
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    n_queries = max(1, -(-blocks[0].bytes // QUERY_BYTES))
    n_vectors = max(1, -(-blocks[1].bytes // CANDIDATE_BYTES), min(tasks, -(-blocks[1].bytes // LEAST_BYTES)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("vec").alias("dims")
    left = queries.select(size, dealt(n_queries).alias("q"), every(n_vectors).alias("c"), "vec_id", "vec")
    right = vectors.select(size, every(n_queries).alias("q"), dealt(n_vectors).alias("c"), "vec_id", "vec")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _best(*_matrix(asked), *_matrix(held), k) if len(asked) and len(held) else RESULT.empty_table()

    keys = ("dims", "q", "c")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _bytes(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.coalesce(F.sum(F.size("vec") + 1), F.lit(0)).alias("n")).select((F.col("n") * 8).alias("bytes"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = table.column("vec").combine_chunks().flatten().to_numpy()
    return table.column("vec_id").to_numpy(), values.reshape(len(table), len(values) // len(table))


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.Table:
    largest = lambda x: max(1.0, -float(x.min(initial=0)), float(x.max(initial=0)))
    most = largest(queries) * largest(vectors) * max(1, queries.shape[1])
    kind = np.float64 if most < EXACT else np.int64 if most < 2.0**62 else object
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    tables = []
    for start in range(0, len(queries), QUERY_BLOCK):
        part = slice(start, start + QUERY_BLOCK)
        for q, c, scores in best_of_blocks(queries[part], query_ids[part], vectors, ids, k):
            whole = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores] if kind is object else scores.astype(np.int64)
            tables.append(pa.Table.from_arrays([pa.array(query_ids[part][q]), pa.array(ids[c]), pa.array(whole, pa.int64())], schema=RESULT))
    return pa.concat_tables(tables)
