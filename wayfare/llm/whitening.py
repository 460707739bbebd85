"""Whitening of embeddings from singular values of the centred rows.

Components become whole numbers, so that counts and sums are exact. Every task centres its
rows by the exact means and reduces them, block by block, to the triangular factor of a QR
decomposition; factors of many tasks are stacked and reduced again until one is left. It has
the singular values of all centred rows, without a covariance whose formation would square
the condition number. ``bidiagonal`` finds its values by dqds and the directions by twisted
factorisations, on a matrix as wide as the vectors are long.

What is written of a row are its first whitened components. Their covariance is taken from
that table, centred first, and checked against the identity.

Defined cases: rows take no part if the vector is NULL or holds a NULL or an entry that is
not finite; a NULL id is kept. Vectors of unequal lengths count as padded with zeros, entries
beyond 2^42 in size as that. Repeated rows count each. Directions without variance have no
rows: their components would be divided by zero; so a table of one row, or of equal rows, has
no result, as has an empty one. A deviation beyond 64 bits is clamped. Only the columns named
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.bidiagonal import EPS, applied, bidiagonal, dqds, vectors
from wayfare.llm.scratch import stored

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LARGEST = float(1 << 52)

BLOCK_ROWS = 4096
# Triangular factors that one task reduces to one.
FAN_IN = 32


def whole(vector: Column) -> Column:
    """Whole numbers of a vector; NULL if it is not there or not all of it is finite."""
    doubles = vector.cast("array<double>")
    finite = F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )

    def number(x: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(x * SCALE, F.lit(LARGEST)), F.lit(-LARGEST)))
        return scaled + F.lit(OFFSET).cast("long")

    return F.when(finite, F.transform(doubles, number))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; what a shorter vector lacks is the number of a zero."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), OFFSET, np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(start, BLOCK_ROWS)


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * width
        for batch in _blocks(batches):
            x = _matrix(batch.column("x"), width)
            # in halves, whose sums over a block cannot overflow
            high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low)]
            count += len(x)
        if count:
            dimensions = pa.array(range(width), pa.int32())
            texts = pa.array(map(str, total), pa.string())
            counts = pa.array([count] * width, pa.int64())
            yield pa.record_batch([dimensions, counts, texts], ["dimension", "n", "total"])

    found = (
        rows.select("x")
        .mapInArrow(added, "dimension int, n long, total string")
        .groupBy("dimension")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    by_dimension = {row["dimension"]: row for row in found}
    n = by_dimension[0]["n"] if found else 0
    return n, [int(by_dimension[k]["total"]) for k in range(width)] if found else [0] * width


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n x - S``, exactly: in 64 bits if all fit, else in Python's whole numbers."""
    largest = max(int(np.abs(x).max(initial=0)) * n, *map(abs, total), 1)
    if largest < 1 << 61:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(deviations: np.ndarray) -> np.ndarray:
    largest = int(np.abs(deviations).max(initial=0))
    if largest**2 * deviations.shape[1] < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(axis=1)
    found = (deviations.astype(object) ** 2).sum(axis=1)
    return np.array([min(int(v), np.iinfo(np.int64).max) for v in found], np.int64)


def factor(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Triangular factor of all rows, centred: blocks in tasks first, then a tree of factors."""
    width = len(total)

    def reduced(parts: Iterator[np.ndarray]) -> pa.RecordBatch | None:
        r = np.zeros((0, width))
        for part in parts:
            r = np.linalg.qr(np.concatenate([r, part]), mode="r")
        return pa.record_batch([pa.array([r.tobytes()], pa.binary())], ["r"]) if len(r) else None

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_matrix(b.column("x"), width) for b in _blocks(batches) if b.num_rows)
        found = reduced((_deviations(x, n, total) / n).astype(np.float64) for x in blocks)
        if found is not None:
            yield found

    def unpacked(packed: bytes) -> np.ndarray:
        return np.frombuffer(packed).reshape(-1, width)

    def of_factors(table: pa.Table) -> pa.Table:
        found = reduced(unpacked(packed.as_py()) for packed in table.column("r"))
        return pa.Table.from_batches([found])

    parts = rows.rdd.getNumPartitions()
    factors = rows.select("x").mapInArrow(of_rows, "r binary")
    factors = factors.withColumn("part", F.spark_partition_id())
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        part = F.floor(F.col("part") / FAN_IN).cast("int").alias("part")
        grouped = factors.select(part, "r").groupBy("part")
        factors = grouped.applyInArrow(
            lambda key, table: of_factors(table).append_column(
                "part", pa.array([key[0].as_py()], pa.int32())
            ),
            "r binary, part int",
        )
    # at most FAN_IN factors, each as large as the vectors are long, squared
    last = [unpacked(bytes(row["r"])) for row in factors.select("r").collect()]
    r = np.linalg.qr(np.concatenate([np.zeros((1, width)), *last]), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))])


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared singular values, falling, their directions as rows, and the sum of all squares.

    A value counts as zero below the rounding of the largest.
    """
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    least = (EPS * len(r)) ** 2 * values.max(initial=0)
    kept = values[:components][values[:components] > least]
    found = vectors(diagonal, above, kept)
    return kept, np.array([applied(right, v) for v in found]).reshape(-1, len(r)), values.sum()


def whitened(
    embeddings: DataFrame, components: int = COMPONENTS
) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """A written table of ``vec_id``, ``n``, ``deviation`` and the array ``whitened``; the
    eigenvalues of the covariance, their directions, and its trace."""
    x = whole(F.col("embedding")).alias("x")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x).where("x IS NOT NULL")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    n, total = sums(rows, width)
    values, axes, trace = directions(factor(rows, n, total), components) if n else (
        np.zeros(0), np.zeros((0, width)), 0.0
    )
    scales = np.sqrt(values / max(n, 1))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            deviations = _deviations(_matrix(batch.column("x"), width), n, total)
            points = (deviations / n).astype(np.float64) @ axes.T / scales
            size = len(axes)
            offsets = pa.array(np.arange(0, (len(points) + 1) * size, size or 1)[: len(points) + 1], pa.int32())
            yield pa.record_batch(
                [
                    batch.column("vec_id"),
                    pa.array(np.full(len(points), n), pa.int64()),
                    pa.array(_squares(deviations)),
                    pa.ListArray.from_arrays(offsets, pa.array(points.ravel())),
                ],
                ["vec_id", "n", "deviation", "whitened"],
            )

    made = rows if len(axes) else rows.limit(0)
    table = made.mapInArrow(
        projected, "vec_id long, n long, deviation long, whitened array<double>"
    )
    return stored(table, "whitened"), values / max(n, 1), axes, trace / max(n, 1)


def identity_error(table: DataFrame, components: int) -> float:
    """Largest difference of the components' covariance from the identity."""
    if not components:
        return 0.0
    entries = [F.get("whitened", F.lit(k)) for k in range(components)]
    means = table.agg(*[F.avg(entry) for entry in entries]).first()
    centred = [entry - F.lit(mean) for entry, mean in zip(entries, means)]
    pairs = [(a, b) for a in range(components) for b in range(a + 1)]
    found = table.agg(*[F.avg(centred[a] * centred[b]) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component, by falling variance."""
    table, values, _, trace = whitened(embeddings, components)
    error = identity_error(table, len(values))
    shares = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    place = F.posexplode("whitened").alias("place", "whitened")
    return table.select("vec_id", "n", "deviation", place).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
