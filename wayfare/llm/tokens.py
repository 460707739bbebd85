"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. The byte lengths of its tokens, summed up, give each token's
span of characters; a token that holds part of a character's bytes spans that character.
Sections are spans of characters too, in order and without overlap. Token spans are joined
to section spans by binary search, and a token is counted in one section:

* the section that holds most of the token's characters; of several with equally many, the
  first. A token that overlaps two sections or more is also counted as ``n_crossing`` there.
* no section, if it overlaps none.

So the counts of sections that cover a text add up to its number of tokens, which separate
encodings of the sections do not. Here the sections are the text's lines, each with the line
feed that ends it.

Defined cases: a NULL or empty text has one section, from 0 to 0, without tokens. Texts and
lines may have any length. Rows are encoded one by one, so repeated rows repeat theirs. Only
the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.ranks import Ranks, ranks, read
from wayfare.llm.text import chunks

LINE_FEED = 10


def spans(encoder: Ranks, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, of each token of a text."""
    ends = np.cumsum(encoder.lengths[encoder.encode(text)])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    starts = np.concatenate([[0], ends[:-1]])
    return character[starts], character[ends - 1] + 1


def lines(text: str) -> np.ndarray:
    """Bounds of the lines: line ``k`` goes from the ``k``-th to the next."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    after = np.flatnonzero(points == LINE_FEED) + 1
    inner = after[after < len(points)]
    return np.concatenate([[0], inner, [len(points)]])


def counted(
    starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; sections go from ``first`` to ``last``."""
    tokens = np.zeros(len(first), np.int64)
    crossing = np.zeros(len(first), np.int64)
    low = np.searchsorted(last, starts, "right")  # first section that ends after the start
    high = np.searchsorted(first, ends, "left")  # sections that begin before the end
    whole = high - low == 1
    np.add.at(tokens, low[whole], 1)
    for token in np.flatnonzero(high - low > 1):
        sections = np.arange(low[token], high[token])
        held = np.minimum(last[sections], ends[token]) - np.maximum(first[sections], starts[token])
        most = sections[held.argmax()]
        tokens[most] += 1
        crossing[most] += 1
    return tokens, crossing


def line_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per line of each document: ``doc_id``, ``section``, its span and its counts."""
    content = docs.sparkSession.sparkContext.broadcast(read(path))
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ranks(content.value, pattern)
        for rows in chunks(batches, "text"):
            parts = []
            for text in rows.column("text").to_pylist():
                bounds = lines(text or "")
                first, last = bounds[:-1], bounds[1:]
                token_spans = spans(encoder, text) if text else (bounds[:0], bounds[:0])
                parts.append((first, last, *counted(*token_spans, first, last)))
            sizes = [len(part[0]) for part in parts]
            section = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)
            ids = rows.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(section), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, section int, " + ", ".join(f"{n} long" for n in names[2:])
    )
