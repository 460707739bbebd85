"""Exact top-k search by inner product on an impact-ordered, score-at-a-time index.

Components are quantised to whole numbers. Vectors are dealt into blocks by hash; a block's
index holds, for each dimension and each value, the segment of the rows that have it there,
and segments stand in order of falling magnitude of the value, their impact. All queries of
a block are scored together: a segment adds its value, times the query's component, to the
scores of its rows.

Processing stops only on proof. What a row has yet to gain lies within the product of the
query's norm and the norm of the row's components not yet processed, by Cauchy-Schwarz. When
the rows whose upper bound reaches the k-th best lower bound are few enough, no other row
can be a member; those few are scored exactly. Without such a proof all segments are
processed and scores are exact as they are.

Equal rows are counted before rows are dealt, so that a block has a bounded number of rows and
queries whatever is repeated. Each pair of a block of rows and one of queries is a task of its
own, so nothing grows with the table but the number of tasks.

Defined cases: rows take no part if the id or the vector is NULL or a component is NULL or
not finite; vectors of unequal lengths count as padded with zeros. A query's own id is no
candidate. Repeated rows are candidates each, and a repeated query is answered once. Values
or scores beyond 64 bits are clamped. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
QUERY_EVERY = 50

BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
# Shares of the index's squared impacts left at which a proof is looked for, and the share of
# rows that may remain to be scored exactly.
CHECKPOINTS = (0.1, 0.03, 0.01, 0.003)
RESCORED = 0.02
# Scores that cannot exceed this are added up in 64-bit integers; Python's take over beyond.
SAFE = 1 << 62
LOWEST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers of a vector; NULL if it is not there or not all of it is finite."""
    doubles = vector.cast("array<double>")
    finite = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, vector in enumerate(vectors):
        out[k, : len(vector)] = vector
    return out


class Index:
    """Segments of a block in order of impact; ``rows`` are its vectors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        place, dimension = np.nonzero(rows)
        value = rows[place, dimension]
        order = np.lexsort((place, dimension, value, -np.abs(value)))
        self.place, dimension, value = place[order], dimension[order], value[order]
        edges = (np.diff(dimension) != 0) | (np.diff(value) != 0)
        starts = np.flatnonzero(np.concatenate([[True], edges])) if len(value) else np.zeros(0, int)
        self.bounds = np.append(starts, len(value))
        self.dimension, self.value = dimension[starts], value[starts]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """By row and query, the scores of all rows that may be among the ``k`` best; others lowest.

        ``own`` marks pairs of rows and queries that are not to be matched.
        """
        rows = self.rows.astype(np.float64)
        left = (rows**2).sum(axis=1)  # squared norm of what is not yet processed
        whole = left.sum()
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        narrow = int(np.abs(self.rows).max(initial=0)) * int(np.abs(queries).max(initial=0))
        kind = np.int32 if narrow * self.rows.shape[1] < 1 << 30 else np.int64
        scores = np.zeros((len(rows), len(queries)), kind)
        columns = np.ascontiguousarray(queries.T.astype(kind))
        checks = [whole * share for share in CHECKPOINTS]
        remaining = whole
        for s, (dimension, value) in enumerate(zip(self.dimension, self.value)):
            places = self.place[self.bounds[s] : self.bounds[s + 1]]
            scores[places] += kind(value) * columns[dimension]
            left[places] -= float(value) ** 2
            remaining -= len(places) * float(value) ** 2
            if checks and remaining <= checks[0]:
                while checks and remaining <= checks[0]:
                    checks.pop(0)
                members = self._members(scores, own, left, norms, k)
                if members.mean() <= RESCORED:
                    return self._rescored(members, queries)
        return np.where(own, LOWEST, scores.astype(np.int64))

    def _members(self, scores, own, left, norms, k) -> np.ndarray:
        """Pairs whose upper bound reaches the ``k``-th best lower bound of the query."""
        # a hair wider than computed, so that rounding cannot cost a member
        slack = np.sqrt(np.maximum(left, 0))[:, None] * norms * (1 + 1e-9) + 1e-6
        low = np.where(own, -np.inf, scores - slack)
        if len(low) <= k:
            return ~own
        least = np.partition(low, len(low) - k, axis=0)[len(low) - k]
        return (scores + slack >= least) & ~own

    def _rescored(self, members: np.ndarray, queries: np.ndarray) -> np.ndarray:
        out = np.full(members.shape, LOWEST)
        for q, query in enumerate(queries):
            rows = np.flatnonzero(members[:, q])
            out[rows, q] = self.rows[rows] @ query
        return out


def _exact(rows: np.ndarray, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Scores in Python's whole numbers, clamped; for values that could overflow."""
    scores = rows.astype(object) @ queries.T.astype(object)
    limits = np.iinfo(np.int64)
    return np.where(own, LOWEST, np.clip(scores, limits.min + 1, limits.max).astype(np.int64))


def best_of_block(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of each query, and ids and scores of its ``k`` best in the block, best first."""
    for q, places, scores in places_of_block(ids, rows, query_ids, queries, k):
        yield q, ids[places], scores


def places_of_block(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of each query, and places and scores of its ``k`` best in the block, best first."""
    own = ids[:, None] == query_ids[None, :]
    peak = int(np.abs(rows.astype(object)).max(initial=0)) * int(
        np.abs(queries.astype(object)).max(initial=0)
    )
    if peak * rows.shape[1] >= SAFE:
        scores = _exact(rows, queries, own)
    else:
        scores = Index(rows).top(queries, own, k)
    for q in range(len(queries)):
        column = scores[:, q]
        kept = np.flatnonzero(~own[:, q] & (column != LOWEST))
        if len(kept) > k:
            least = np.partition(column[kept], len(kept) - k)[len(kept) - k]
            kept = kept[column[kept] >= least]
        order = sorted(range(len(kept)), key=lambda j: (-int(column[kept[j]]), int(ids[kept[j]])))
        chosen = kept[order[:k]]
        yield q, chosen, column[chosen]


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """The ``k`` best rows for each row whose id is divisible by ``every``, against all rows."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector")
    ).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, query_blocks = -(-n // BLOCK_ROWS) or 1, -(-n_queries // BLOCK_QUERIES) or 1

    def dealt(df: DataFrame, own: str, number: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number)).cast("int")
        return df.withColumn(own, block).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        )

    left = dealt(rows, "block", blocks, "query_block", query_blocks)
    queries = rows.where(asked).drop("copies")
    right = dealt(queries, "query_block", query_blocks, "block", blocks)
    keys = ["block", "query_block"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query", "vec_id", "copies", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
        width = max(map(len, [*left["vector"], *right["vector"]]))
        ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        copies, of = left["copies"].to_numpy(), right["query"].to_numpy()
        matrix, queries = (_padded(side["vector"].tolist(), width) for side in (left, right))
        parts = [
            (np.full(len(p), query_ids[q]), np.full(len(p), of[q]), ids[p], copies[p], scores)
            for q, p, scores in places_of_block(ids, matrix, query_ids, queries, k)
        ]
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))

    right = right.withColumn("query", F.xxhash64("vector"))
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(best, "query_id long, query long, vec_id long, copies long, score long")
    )
    # repeated rows come one by one, as many as can be among the best
    one_by_one = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k))))
    found = found.withColumn("copy", one_by_one)
    by_score = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


SEARCH_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= {K}
"""
