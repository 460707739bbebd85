"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit position in which over half of the hashes of a text's
shingles are set. Texts whose fingerprints differ in at most ``RADIUS`` bits are linked, and
components of linked texts are groups. Copies share a fingerprint and are one node.

Covering: bit position ``i`` gets a non-zero vector over GF(2) of ``radius + 1`` dimensions,
and for each non-zero vector ``w`` there is a table keyed by the bits whose vector has an odd
product with ``w``. Up to ``radius`` differing positions leave some ``w`` orthogonal to all of
their vectors, so the pair agrees in that table's key: no link is missed, whatever the data.

Within a bucket a search outward from one fingerprint at a time finds who is linked and gives
one link per fingerprint reached, never all pairs. A bucket of more than ``BUCKET`` fingerprints
is not searched but covered again on the bits its key leaves free; after three covers 15 of 64
bits are free at most, so that every bucket has a bound.

Defined cases: a NULL text or one without words has fingerprint zero and is linked like any
other. A group's id is its smallest id; NULL if it has none. Repeated rows are in one group.
An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.components import roots
from wayfare.llm.scratch import stored
from wayfare.llm.text import chunks

SHINGLE = 4
RADIUS = 4
BITS = 64
SEED = 42
BUCKET = 1 << 15
# Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    size = min(shingle, len(words))
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), COUNTED):
        part = hashes[k : k + COUNTED].view(np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with column ``fp`` in the place of ``text``."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "text"):
            prints = [fingerprint(t, shingle) for t in rows.column("text").to_pylist()]
            kept = [rows.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(prints, pa.int64())], names=[*[f.name for f in others], "fp"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    ordered = docs.select(*[f.name for f in others], "text")
    return ordered.mapInArrow(run, ", ".join([*fields, "fp long"]))


def covering(mask: int, radius: int) -> list[int]:
    """Masks that contain ``mask`` and cover the bits outside it."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    vectors = (1 << radius + 1) - 1
    masks = []
    for w in range(1, vectors + 1):
        odd = [i for k, i in enumerate(free) if ((1 + k % vectors) & w).bit_count() % 2]
        masks.append(mask | sum(1 << i for i in odd))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def _reached(prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a bucket's distinct fingerprints that join what any of its links join."""
    rest = prints
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for center in front:
                near = np.bitwise_count(rest ^ center) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    queue.append(found)
                    yield np.full(len(found), center), found


def _links(buckets: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Links within buckets, rows ``mask`` and ``fp``; of too large ones the rows, with NULL ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray | None, mask: np.ndarray) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            columns = [pa.array(a.view(np.int64)), b, pa.array(mask.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "mask"])

        def search(prints: np.ndarray, mask: np.uint64) -> Iterator[pa.RecordBatch]:
            found = list(_reached(prints, radius)) if len(prints) > 1 else []
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                yield rows(a, b, np.full(len(a), mask))

        held, held_mask, large = np.zeros(0, np.uint64), np.uint64(0), False
        for batch in batches:
            masks, prints = (batch.column(n).to_numpy().view(np.uint64) for n in ("mask", "fp"))
            if not len(prints):
                continue
            keys = masks & prints
            new = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(prints)]
            if len(held) and (held_mask != masks[0] or held[0] & held_mask != keys[0]):
                if not large:
                    yield from search(held, held_mask)
                held, large = held[:0], False
            # the last bucket may go on in the next batch
            many = ends - starts > 1
            many[[0, -1]] = True
            for start, end in zip(starts[many].tolist(), ends[many].tolist()):
                own, mask = prints[start:end], masks[start]
                if start == 0 and len(held):
                    own = own if large else np.concatenate([held, own])
                    held = held[:0]
                elif start:
                    large = False
                if large or len(own) > bucket:
                    yield rows(own, None, np.full(len(own), mask))
                    large = True
                if end == len(prints):
                    held, held_mask = own, mask
                elif not large:
                    yield from search(own, mask)
        if len(held) and not large:
            yield from search(held, held_mask)

    key = [F.col("mask"), F.col("mask").bitwiseAND(F.col("fp"))]
    sorted_ = buckets.repartition(*key).sortWithinPartitions(*key, "fp")
    return sorted_.select("mask", "fp").mapInArrow(run, "a long, b long, mask long")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a`` and ``b``: links that connect the distinct ``fp`` as all pairs within the radius do."""
    first = F.array(*[F.lit(_signed(m)).cast("long") for m in covering(0, radius)])
    buckets = prints.select(F.explode(first).alias("mask"), "fp")
    found = stored(_links(buckets, radius, bucket), "links")
    everything = found.where("b IS NOT NULL")
    while not (large := found.where("b IS NULL")).isEmpty():

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                masks, prints = (batch.column(n).to_numpy().view(np.uint64) for n in ("mask", "a"))
                for mask in np.unique(masks):
                    own = prints[masks == mask]
                    for wider in covering(int(mask), radius):
                        wide = np.full(len(own), wider, np.uint64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(wide.view(np.int64)), pa.array(own.view(np.int64))],
                            names=["mask", "fp"],
                        )

        buckets = large.select("mask", "a").mapInArrow(refine, "mask long, fp long").distinct()
        found = stored(_links(buckets, radius, bucket), "links")
        everything = everything.unionByName(found.where("b IS NOT NULL"))
    return everything.select("a", "b")


def _grouped(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """``fp``, ``root`` and ``first``: the least over the whole group; ``prints`` is a written table."""
    nodes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    lead = stored(roots(links(nodes.select("fp"), radius), "a", "b"), "roots")
    rooted = stored(
        nodes.join(lead, nodes.fp == lead.node, "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "first"
        ),
        "rooted",
    )
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "least")
    return stored(rooted.drop("first").join(least, "root"), "groups")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` and ``component_id``."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle), "prints")
    members = _grouped(prints, F.col("doc_id"), radius)
    return prints.join(members, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, NULL ids last.

    Rows are told apart by id and a hash of all their columns; of rows that agree in both,
    which are copies of one another, one stays.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = stored(
        fingerprints(docs.select("doc_id", row.alias("row"), "text"), shingle), "prints"
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = _grouped(prints, order, radius).select("root", "first").distinct()
    copies = prints.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    chosen = first.select(
        F.col("first.doc_id").alias("_kept_id"), F.col("first.row").alias("_kept_row")
    )
    same = F.col("_kept_id").eqNullSafe(F.col("doc_id")) & (F.col("_kept_row") == F.col("row"))
    copied = F.col("n").alias("_kept_copies")
    chosen = stored(chosen.join(copies, same).select("_kept_id", "_kept_row", copied), "chosen")
    matched = docs.alias("d").join(
        chosen,
        F.col("_kept_id").eqNullSafe(F.col("d.doc_id")) & (F.col("_kept_row") == row),
    )
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    if chosen.where("_kept_copies > 1").isEmpty():
        return matched.select(*columns)
    once = matched.where("_kept_copies = 1").select(*columns)
    return once.unionByName(
        matched.where("_kept_copies > 1").dropDuplicates(["_kept_id", "_kept_row"]).select(*columns)
    )
