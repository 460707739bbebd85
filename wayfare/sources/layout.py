"""Tables in files that each hold a range of a key, and which files a range of it needs.

Files are cut by size, not by value: a quiet year may share one, a busy day may have many.
With the table goes a list of its files with the least and greatest key in each, taken once
when the table is written. A reader of a range opens only the files that overlap it,
and within them only the row groups whose footers say so.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import file_bytes

# What a file should hold, and the least that is worth a task of its own on a small table.
FILE_BYTES = 128 * 1024**2
LEAST_BYTES = 8 * 1024**2


def file_count(nbytes: int, cores: int) -> int:
    """Files for so many bytes: of ``FILE_BYTES``, or smaller to keep all cores busy."""
    return max(1, -(-nbytes // FILE_BYTES), min(cores, nbytes // LEAST_BYTES))


# name, least and greatest key in microseconds since 1970; no keys if none is set in the file
FileRange = tuple[str, int | None, int | None]


def write_ranges(
    df: DataFrame, path: str, key: str, spread_by: list[str], columns: list[str]
) -> list[FileRange]:
    """Write ``columns`` of ``df`` to ``path`` in ranges of ``key``; the files' ranges.

    Rows with one key, or none, are many at times; a hash of ``spread_by`` in the order lets
    them fill several files. How many files there are follows from the bytes that ``df`` is
    read from; where that is unknown, adaptive execution decides by the size of the shuffle.
    """
    spark = df.sparkSession
    order = [F.col(key).asc_nulls_last(), F.xxhash64(*spread_by)]
    nbytes = file_bytes(df)
    if nbytes is None:
        dealt = df.repartitionByRange(*order)
    else:
        dealt = df.repartitionByRange(file_count(nbytes, spark.sparkContext.defaultParallelism), *order)
    sorted_rows = dealt.sortWithinPartitions(*order).select(*columns)
    sorted_rows.write.mode("overwrite").parquet(path)
    written = spark.read.schema(sorted_rows.schema).parquet(path)
    instant = F.unix_micros(F.col(key).cast("timestamp"))
    # a row for each file of about FILE_BYTES, as many as the driver lists anyway
    listed = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(instant).alias("first"), F.max(instant).alias("last")
    )
    return sorted(map(tuple, listed.collect()))


def micros(day: dt.date) -> int:
    """The first instant of a day, in UTC as all sessions of this package have it."""
    return (day - dt.date(1970, 1, 1)).days * 86_400_000_000


def overlapping(
    listed: list[FileRange], since: dt.date | None, until: dt.date | None
) -> list[str]:
    """Files that may hold an instant of the days, both included; None is no bound."""
    low = None if since is None else micros(since)
    high = None if until is None else micros(until) + micros(dt.date(1970, 1, 2))
    return [
        name
        for name, first, last in listed
        if first is not None
        and (high is None or first < high)
        and (low is None or last >= low)
    ]
