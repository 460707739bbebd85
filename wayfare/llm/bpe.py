"""Byte-pair encoding and decoding with a tokenization automaton.

``encode`` normalises and pre-splits whole texts as the vocabulary's file says, and encodes
each word by transitions of the automaton of ``automaton.py``: the last token of every
prefix of a word is the one whose arc exists from the state of the prefix before it, of
which there is exactly one. ``decode`` emits the labels of arcs, joined as the file says.

Vocabulary files are those of the tokenizers library: BPE with a word-end suffix over
byte-level characters, special tokens matched in the raw text. A file of a few megabytes is
read by the driver and broadcast; its automaton is made once per Python worker. Text whose
characters all lie below U+023A is normalised and split here; the library's own normaliser
and splitter take the rest, because their tables are those of another Unicode version.

Defined cases: a NULL text is empty, and an empty text has no tokens and decodes to "".
Rows are encoded one by one, so repeated rows and extra columns need no care. A word may have any length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.automaton import DEAD, Automaton, byte_characters
from wayfare.llm.text import chunks

# Words kept with their ids in a worker; a full table is emptied and starts over.
CACHED_WORDS = 250_000
CACHED_BYTES = 64
# Words of more bytes are read from the front, not from the end by recursion.
SHORT_WORD = 64

# Splitting in the classes of the file's own pattern. Characters below the
# first limit have lower-case letters below the second one, and no composition.
TEXT_LIMIT = 0x23A
SPLIT_LIMIT = 0x300
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = "\t\n\x0b\f\r \x85\xa0"


def _class(*kinds: str) -> str:
    found = [chr(c) for c in range(SPLIT_LIMIT) if unicodedata.category(chr(c))[0] in kinds]
    return "".join(re.escape(c) for c in found)


@lru_cache(maxsize=1)
def _low_pattern() -> tuple[re.Pattern, re.Pattern]:
    """Text to take here, and its pieces once it is in lower case."""
    letters, digits = _class("L"), _class("N")
    rest = f"[^{re.escape(WHITE)}{letters}{digits}]+"
    ends = "|".join(CONTRACTIONS)
    high = re.compile(f"[^\x00-{chr(TEXT_LIMIT - 1)}]")
    return high, re.compile(f"[{letters}]+|'(?:{ends})|[{digits}]|{rest}")


class Words(dict):
    """Ids of a word as bytes, by word; computed when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A vocabulary file: splitting, the automaton and the labels of its arcs."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(content)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not self.suffix or spec["decoder"] is not None:
            raise ValueError("the vocabulary must mark word ends and have no decoder of its own")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in (ids | self.special).items()}
        marks = byte_characters()
        self.byte = {c: b for b, c in enumerate(marks)}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in ids.items():
            end = token.endswith(self.suffix) and token != self.suffix
            text = token[: -len(self.suffix)] if end else token
            raw = bytes(self.byte[c] for c in text)
            (self.final if end else self.inner)[raw] = i
        merges = []
        for x, y in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            merges.append((ids[x], ids[y], ids[x + y]))
        self.automaton = Automaton(max(ids.values()) + 1, merges)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.words = Words(lambda word: self._ids(word.encode()).tobytes())
        self.special_pattern = re.compile(
            "(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        )

    def _ids(self, word: bytes) -> array:
        """Tokens of a word: the one arc that leads on to each prefix, then back from the end."""
        last: dict[int, tuple[int, int]] = {}  # of a prefix: where its last token starts, and it
        states = {0: 0}
        if len(word) <= SHORT_WORD:
            self._reach(word, len(word), self.final, states, last)
        else:
            # every prefix in turn, so that none has to be reached through another
            for end in range(1, len(word) + 1):
                self._reach(word, end, self.final if end == len(word) else self.inner, states, last)
        found, end = [], len(word)
        while end:
            end, token = last[end]
            found.append(token)
        return array("I", reversed(found))

    def _reach(self, word: bytes, end: int, labels: dict, states: dict, last: dict) -> int:
        """State after the tokens of ``word[:end]``; prefixes on the way are reached as needed."""
        for start in range(max(0, end - self.longest), end):
            token = labels.get(word[start:end])
            if token is None:
                continue
            before = states.get(start)
            if before is None:
                before = self._reach(word, start, self.inner, states, last)
            state = self.automaton.step(before, token)
            if state != DEAD:
                states[end], last[end] = state, (start, token)
                return state
        raise ValueError("the vocabulary lacks a byte")

    def pieces(self, text: str) -> list[str]:
        high, low = _low_pattern()
        if not high.search(text):
            return low.findall(text.lower())
        marked = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, piece)).decode() for piece, _ in marked]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if "<" not in text:
            return b"".join(map(self.words.__getitem__, self.pieces(text)))
        parts = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                parts.append(array("I", [self.special[part]]).tobytes())
            else:
                parts += map(self.words.__getitem__, self.pieces(part))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _added(df: DataFrame, path: str, columns: dict[str, T.DataType], measure: str, fill) -> DataFrame:
    """``df`` with more columns, which ``fill(vocabulary, rows)`` gives for an Arrow batch."""
    content = df.sparkSession.sparkContext.broadcast(_read(path))
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for rows in chunks(batches, measure):
            added = fill(vocabulary, rows)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *added], names=[*rows.schema.names, *columns]
            )

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the tokens of ``text`` as bytes: little-endian unsigned 32-bit integers."""

    def fill(vocabulary: Vocabulary, rows: pa.RecordBatch) -> list[pa.Array]:
        texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
        return [pa.array([vocabulary.encode(t or "") for t in texts], pa.binary())]

    return _added(docs, path, {ids: T.BinaryType()}, text, fill)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the tokens in ``ids``, written as ``encode`` writes them."""

    def fill(vocabulary: Vocabulary, rows: pa.RecordBatch) -> list[pa.Array]:
        coded = rows.column(rows.schema.get_field_index(ids)).to_pylist()
        return [pa.array([vocabulary.decode(i or b"") for i in coded], pa.string())]

    return _added(df, path, {text: T.StringType()}, ids, fill)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of tokens and digests of the ids and the decoded text."""
    coded = encode(docs.select("doc_id", "text"), path).drop("text")
    return decode(coded, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``input_ids`` in the place of ``text``, ``n_tokens`` and two digests.

    ``ids_sha256`` is that of the ids as ``encode`` writes them, ``decoded_sha256`` that of
    the text that they decode to.
    """
    columns = {
        "input_ids": T.ArrayType(T.IntegerType()),
        "n_tokens": T.LongType(),
        "ids_sha256": T.StringType(),
        "decoded_sha256": T.StringType(),
    }

    def fill(vocabulary: Vocabulary, rows: pa.RecordBatch) -> list[pa.Array]:
        texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
        coded = [vocabulary.encode(t or "") for t in texts]
        sizes = [len(ids) // 4 for ids in coded]
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        return [
            pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<i4"))),
            pa.array(sizes, pa.int64()),
            pa.array([digest(ids) for ids in coded]),
            pa.array([digest(vocabulary.decode(ids).encode("utf-8")) for ids in coded]),
        ]

    names = [c for c in docs.columns if c not in ("text", *columns)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    return _added(rows, path, columns, "text", fill).select(*[F.col(f"`{c}`") for c in names], *columns)
