"""Hard negatives by exact Four-Russians scoring.

Components are quantised to whole numbers and written in two's complement. Of eight
dimensions, the bits of one weight make a byte; a row is packed into a byte for each group of
eight dimensions and each weight, its bit planes. For an anchor, a table holds for each group
the sums of all 256 subsets of its eight components. The inner product with a row then needs
no multiplication: the row's bytes index the tables, the entries of a plane are added up, and
planes are joined by shifting, the plane of the sign being subtracted. Scores are exact.

Rows are scored twice at most, first those with the label of the anchor for its positives, then
those with others for its negatives, so that no row is left out of either search and nothing
has to be guessed. A positive's negatives lie within two bounds that follow from its score. The
scores of a block's rows are sorted once for an anchor, and the bounds of all its positives
are looked up in that order.

Equal rows are counted before rows are dealt to blocks by hash, so that a block has a bounded
number of rows whatever is repeated, and each pair of a block of rows and one of anchors is a
task of its own. What is sent to the tasks are packed bytes.

Defined cases: rows take no part if the id, the label or the vector is NULL or a component is
NULL or not finite; vectors of unequal lengths count as padded with zeros. Rows under the
anchor's own id are no positives. Repeated rows are positives and negatives each, and a
repeated anchor is answered once; different rows under the id of an anchor are anchors each.
Values and scores beyond 64 bits are clamped. An anchor without a positive, or a positive
without a negative, has no rows. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.scratch import stored
from wayfare.llm.topk import SAFE, quantised

POSITIVES = 5
NEGATIVES = 3
ANCHOR_EVERY = 50
# Percent of the positive's score that a negative's must have, least and most.
LEAST_PERCENT, MOST_PERCENT = 50, 95

# Every so many ids a label is moved on by one, among so many labels.
MOVED_EVERY = 7
LABELS = 10

GROUP = 8
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 1024
# Rows and anchors scored at a time.
TILE_ROWS, TILE_ANCHORS = 4096, 128


def groups_of(width: int) -> int:
    return max(1, -(-width // GROUP))


def packed(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes by row, weight and group; bit ``k`` of a byte is the group's dimension ``k``."""
    rows, width = vectors.shape
    groups = groups_of(width)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :width] = vectors
    weights = np.arange(planes, dtype=np.int64)
    bits = (padded[:, None, :] >> weights[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """By group and byte, the sum of the components that the byte's bits choose; by anchor."""
    count, width = anchors.shape
    groups = groups_of(width)
    padded = np.zeros((count, groups * GROUP), anchors.dtype)
    padded[:, :width] = anchors
    by_group = padded.T.reshape(groups, GROUP, count)
    sums = np.zeros((groups, 1, count), anchors.dtype)
    for k in range(GROUP):
        sums = np.concatenate([sums, sums + by_group[:, k : k + 1]], axis=1)
    return sums


def scored(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of packed rows and the anchors behind the tables, by row and anchor."""
    planes = rows.shape[1]
    scores = np.zeros((len(rows), tables.shape[2]), tables.dtype)
    for weight in reversed(range(planes)):
        plane = tables[0][rows[:, weight, 0]]
        for group in range(1, len(tables)):
            plane += tables[group][rows[:, weight, group]]
        if weight == planes - 1:  # two's complement: the highest bit counts negative
            scores -= plane
        else:
            scores = scores + scores
            scores += plane
    return scores


class Anchors:
    """Anchors of a block, in numbers wide enough for their scores with rows of so many planes."""

    def __init__(self, vectors: np.ndarray, planes: int):
        most = int(np.abs(vectors.astype(object)).max(initial=0)) * vectors.shape[1]
        bound = most << planes
        # a score, times 128, fits the numbers used
        self.kind = np.int32 if bound < 1 << 30 else np.int64 if bound < SAFE >> 7 else object
        self.vectors = vectors.astype(self.kind)

    def tiles(self) -> Iterator[tuple[slice, np.ndarray]]:
        for start in range(0, len(self.vectors), TILE_ANCHORS):
            part = slice(start, start + TILE_ANCHORS)
            yield part, subset_sums(self.vectors[part])


def _whole(scores: np.ndarray) -> np.ndarray:
    limits = np.iinfo(np.int64)
    if scores.dtype == object:
        scores = np.clip(scores, limits.min + 1, limits.max)
    return scores.astype(np.int64)


def _scores(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    parts = [
        _whole(scored(rows[k : k + TILE_ROWS], tables)) for k in range(0, len(rows), TILE_ROWS)
    ]
    return np.concatenate(parts)


def positives_of_block(
    ids: np.ndarray, labels: np.ndarray, rows: np.ndarray,
    anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: Anchors, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of an anchor, and the places and scores of its ``k`` best rows of its label."""
    by_label = {label: np.flatnonzero(labels == label) for label in np.unique(anchor_labels)}
    order = np.argsort(anchor_labels, kind="stable")
    edges = np.flatnonzero(np.diff(anchor_labels[order])) + 1
    for same in np.split(order, edges):
        if not len(same):
            continue
        rivals = by_label[anchor_labels[same[0]]]
        rivals = rivals[np.argsort(ids[rivals], kind="stable")]
        for start in range(0, len(same) if len(rivals) else 0, TILE_ANCHORS):
            part = same[start : start + TILE_ANCHORS]
            scores = _scores(rows[rivals], subset_sums(anchors.vectors[part]))
            for a, anchor in enumerate(part):
                column = scores[:, a]
                others = np.flatnonzero(ids[rivals] != anchor_ids[anchor])
                if len(others) > k:
                    least = np.partition(column[others], len(others) - k)[len(others) - k]
                    others = others[column[others] >= least]
                # rivals stand by id, so that a stable sort settles ties
                best = others[np.argsort(-column[others], kind="stable")[:k]]
                yield anchor, rivals[best], column[best]


def negatives_of_block(
    ids: np.ndarray, labels: np.ndarray, rows: np.ndarray,
    anchor_labels: np.ndarray, anchors: Anchors, bounds: list[list[tuple[int, int]]], k: int,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Places of an anchor and of one of its ``bounds``, and the places and scores of the ``k``
    best rows of another label whose scores lie within."""
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    for part, tables in anchors.tiles():
        scores = _scores(rows, tables)
        for a, anchor in enumerate(range(part.start, min(part.stop, len(anchors.vectors)))):
            others = np.flatnonzero(labels != anchor_labels[anchor])
            column = scores[others, a]
            ranked = np.argsort(-column, kind="stable")
            falling = -column[ranked]
            for b, (least, most) in enumerate(bounds[anchor]):
                start = np.searchsorted(falling, -most, "left")
                stop = np.searchsorted(falling, -least, "right")
                chosen = ranked[start : min(stop, start + k)]
                if len(chosen):
                    yield anchor, b, order[others[chosen]], column[chosen]


def bounds_of(score: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives; least above greatest if there are none."""
    return -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100


def moved_label() -> Column:
    label, moves = F.col("label").cast("long"), F.col("vec_id") % MOVED_EVERY == 0
    return F.when(moves, (label + 1) % LABELS).otherwise(label)


def mine(
    vectors: DataFrame,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = ANCHOR_EVERY,
) -> DataFrame:
    """For each row whose id is divisible by ``every`` and each of its ``positives`` best rows of
    the same label, the ``negatives`` best rows of other labels within the bounds."""
    label = F.col("label").cast("long") if label is None else label
    rows = (
        vectors.select("vec_id", "label", "embedding")
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.alias("label"),
            quantised(F.col("embedding")).alias("vector"),
        )
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
        .groupBy("vec_id", "label", "vector")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = stored(rows, "rows")
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, n_anchors, width, low, high = rows.agg(
        F.count(F.lit(1)),
        F.count_if(asked),
        F.max(F.size("vector")),
        F.min(F.array_min("vector")),
        F.max(F.array_max("vector")),
    ).first()
    width = max(width or 0, 1)
    # in two's complement, with the bit of the sign
    planes = 1 + max((x if x >= 0 else ~x).bit_length() for x in (low or 0, high or 0))
    blocks, anchor_blocks = -(-n // BLOCK_ROWS) or 1, -(-n_anchors // BLOCK_ANCHORS) or 1
    groups = groups_of(width)

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for k, vector in enumerate(vectors):
            out[k, : len(vector)] = vector
        return out

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in packed(matrix(vectors), planes)])

    def unpacked(rows: pd.Series) -> np.ndarray:
        whole = np.frombuffer(b"".join(rows), np.uint8)
        return whole.reshape(len(rows), planes, groups)

    def dealt(df: DataFrame, own: str, number: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(number)).cast("int")
        return df.withColumn(own, block).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        )

    keys = ["block", "anchor_block"]
    anchors = rows.where(asked).withColumn("anchor", F.xxhash64("label", "vector")).drop("copies")
    dealt_rows = dealt(rows, "block", blocks, "anchor_block", anchor_blocks).select(
        *keys, "vec_id", "label", "copies", pack("vector").alias("packed")
    )
    names = ["anchor_id", "anchor", "vec_id", "copies", "score"]
    numbers = ", ".join(f"{name} long" for name in names)

    def best_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
        ids, copies = left["vec_id"].to_numpy(), left["copies"].to_numpy()
        anchor_ids, of = right["vec_id"].to_numpy(), right["anchor"].to_numpy()
        found = positives_of_block(
            ids, left["label"].to_numpy(), unpacked(left["packed"]),
            anchor_ids, right["label"].to_numpy(), Anchors(matrix(right["vector"]), planes), positives,
        )
        parts = [
            (np.full(len(p), anchor_ids[a]), np.full(len(p), of[a]), ids[p], copies[p], scores)
            for a, p, scores in found
        ]
        columns = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(names, columns)))

    def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
        """The first ``k`` of each group, repeated rows one by one."""
        one_by_one = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k))))
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return (
            df.withColumn("copy", one_by_one)
            .withColumn("rank", F.row_number().over(order).cast("int"))
            .where(F.col("rank") <= k)
        )

    right = dealt(anchors, "anchor_block", anchor_blocks, "block", blocks)
    found = (
        dealt_rows.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(best_positives, numbers)
    )
    best = ranked(found, ["anchor_id", "anchor"], positives).select(
        "anchor_id",
        "anchor",
        F.struct("rank", F.col("vec_id").alias("id"), "score").alias("positive"),
    )
    # an anchor's positives, a handful, stand beside it
    positive = F.sort_array(F.collect_list("positive")).alias("positives")
    chosen = (
        best.groupBy("anchor_id", "anchor")
        .agg(positive)
        .select(
            "anchor_id",
            "anchor",
            F.col("positives.id").alias("positive_ids"),
            F.col("positives.score").alias("positive_scores"),
        )
    )
    asking = anchors.withColumnRenamed("vec_id", "anchor_id").join(chosen, ["anchor_id", "anchor"])
    asking = stored(asking.withColumnRenamed("anchor_id", "vec_id"), "anchors")

    more = ["place", "positive_id", "positive_score"]

    def best_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names + more})
        ids, copies = left["vec_id"].to_numpy(), left["copies"].to_numpy()
        anchor_ids, of = right["vec_id"].to_numpy(), right["anchor"].to_numpy()
        positive_ids, scores_of = right["positive_ids"], right["positive_scores"]
        found = negatives_of_block(
            ids, left["label"].to_numpy(), unpacked(left["packed"]),
            right["label"].to_numpy(), Anchors(matrix(right["vector"]), planes),
            [[bounds_of(int(score)) for score in each] for each in scores_of], negatives,
        )
        parts = []
        for a, b, places, scores in found:
            fixed = (anchor_ids[a], of[a], b, positive_ids.iloc[a][b], scores_of.iloc[a][b])
            one, two, *rest = (np.full(len(places), value, np.int64) for value in fixed)
            parts.append((one, two, ids[places], copies[places], scores, *rest))
        columns = map(np.concatenate, zip(*parts)) if parts else [np.zeros(0, np.int64)] * 8
        return pd.DataFrame(dict(zip(names + more, columns)))

    right = dealt(asking, "anchor_block", anchor_blocks, "block", blocks)
    found = (
        dealt_rows.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(best_negatives, f"{numbers}, {', '.join(f'{name} long' for name in more)}")
    )
    return ranked(found, ["anchor_id", "anchor", "place"], negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives under the labels that the query is asked with."""
    return mine(vectors, moved_label())


MINE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)::DOUBLE[] AS q,
    CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
  ) WHERE place <= {POSITIVES}
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * positive_score
) WHERE rank <= {NEGATIVES}
"""
