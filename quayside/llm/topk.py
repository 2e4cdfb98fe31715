"""Exact top-k search by term-at-a-time accumulation (operator 6).

A vector's components are terms.  Rows are dealt to blocks, and each block of
queries meets each block of candidates in one task, which builds posting lists
of the candidates by term.  A query walks its non-zero terms; each scatters its
weight times the postings' weights into a dense array of integer scores.  A
partition selects its k best, and the blocks' best merge.  Every score is
computed, so the work grows with queries times candidates, but no pair of rows
leaves a task except the k best of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bound_batches, cut, read_table

K = 20
SCALE = 64
QUERY_EVERY = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384


class Postings:
    """Lists of (row, weight) by term; a term that most rows hold is a dense row of weights."""

    def __init__(self, matrix: np.ndarray):
        self.n = len(matrix)
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for column in np.ascontiguousarray(matrix.T):
            rows = np.flatnonzero(column)
            dense = len(rows) > self.n // 4
            self.lists.append((None, column) if dense else (rows, column[rows]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, self.lists[0][1].dtype if self.lists else np.int64)
        for term in np.flatnonzero(query):
            rows, weights = self.lists[term]
            if rows is None:
                out += query[term] * weights
            else:
                out[rows] += query[term] * weights
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores in order, ties to smaller ids, which are sorted already."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(ids: list[np.ndarray], flat: list[np.ndarray], sizes: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order with their padded vectors."""
    one, values, size = np.concatenate(ids), np.concatenate(flat), np.concatenate(sizes)
    out = np.zeros((len(one), width), np.int64)
    row = np.repeat(np.arange(len(one)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    order = np.argsort(one, kind="stable")
    return one[order], out[order]


def _searched(k: int, exclude_own: bool):
    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        sides = []
        for t in (left, right):
            v = t.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            sides.append((t.column("vec_id").to_numpy(), v.flatten().to_numpy(), np.diff(v.offsets.to_numpy())))
        width = max(int(s[2].max()) for s in sides)
        (q_ids, q), (c_ids, c) = (_matrix([i], [f], [n], width) for i, f, n in sides)
        bound = width * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
        kind = np.int32 if bound < 2**31 else np.int64
        postings, q = Postings(c.astype(kind)), q.astype(kind)
        found = []
        for ident, query in zip(q_ids, q, strict=True):
            scores = postings.scores(query)
            own = (np.searchsorted(c_ids, ident), np.searchsorted(c_ids, ident, side="right")) if exclude_own else (0, 0)
            if own[0] == own[1]:
                at = best(scores, c_ids, k)
            else:
                keep = np.r_[0 : own[0], own[1] : len(c_ids)]
                at = keep[best(scores[keep], c_ids[keep], k)]
            found.append((np.full(len(at), ident), c_ids[at], scores[at].astype(np.int64)))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts), strict=True)))

    return search


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every vector that is not null and holds finite numbers only."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.filter(v.isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .filter(finite)
        .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = K,
    exclude_own: bool = True,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query, both sides (vec_id, v) of integers.

    Ties go to the smaller id.  With `exclude_own` no row with the query's id is a
    candidate.  Query rows of one id are one query, the smallest vector's; a repeated candidate row ranks
    as often as it comes.  Vectors of different lengths meet as if padded by
    zeros, and an empty one scores 0.  Empty tables give no rows.
    """
    spark = queries.sparkSession
    bound_batches(spark)
    queries, candidates = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v"))), cut(candidates)
    q_blocks = max(1, -(-queries.count() // query_block))
    c_blocks = max(1, -(-candidates.count() // candidate_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", deal(q_blocks).alias("q"), every(c_blocks).alias("c"))
    apart = F.floor(F.rand(7) * c_blocks).cast("int")  # not by id, which may repeat; the rows are checkpointed, so reruns agree
    right = candidates.select("vec_id", "v", every(q_blocks).alias("q"), apart.alias("c"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(
        _searched(k, exclude_own), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.filter(F.col("vec_id") % QUERY_EVERY == 0), rows)


OP6_SQL = f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= {K}
"""
