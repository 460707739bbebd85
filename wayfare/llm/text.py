"""White space, words and Arrow rows, as all text operators take them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The six characters between words, and the same as a class of characters.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

# Rows of one Arrow batch that Python code turns into objects at a time, by their bytes.
CHUNK_BYTES = 4 * 1024**2


def words(text: Column) -> Column:
    """Array of the words of a text; empty for NULL and for text without a word.

    One-character replacement and splitting need no regular expression, which makes this
    the cheapest of the built-in ways.
    """
    spaced = reduce(
        lambda t, space: F.replace(t, F.lit(space), F.lit(" ")),
        SPACES[1:],
        F.coalesce(text, F.lit("")),
    )
    return F.array_remove(F.split(spaced, " "), "")


def chunks(batches: Iterator[pa.RecordBatch], measure: str) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about ``CHUNK_BYTES`` of the ``measure`` column, one row at least.

    A batch holds a fixed number of rows, which long texts make large; slicing bounds what is
    turned into Python objects, and what is sent back, at once.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(measure)).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            size += length or 0
            if size >= CHUNK_BYTES:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
