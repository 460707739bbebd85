"""Log probability of documents under all their segmentations into pieces of a vocabulary.

The vocabulary is an existing one; a word, with a mark before it, can be spelled by its pieces
in many ways, and by single bytes always. A piece has a probability of its own, a document's
pieces are drawn independently until the end is drawn, and the probability of the text is the
sum over every sequence of pieces that spells it. The forward recursion carries, in logs, the
probability of all ways to reach each byte, over the arcs of the word's lattice. As no piece
reaches over a mark, all ways meet there, and the document's recursion is the sum of its
words'; each distinct word is computed once.

Scores start from those of the vocabulary, whose ranks are taken as a harmonic prior, and are
fitted to the words of all training documents by expectation and maximisation: the forward
and backward recursions of every distinct word give how often each piece is expected in it.

Words are counted over all documents. Those with a great share of all tokens, which are few,
are sent to every task, the others are joined, one row for each document and word, by their
words; neither then has a key with many rows.

Defined cases: a NULL text is empty and has the end as its only token. A NULL id counts as an
empty one. Repeated rows are scored and learned from each. Text that is not in the vocabulary
is spelled by bytes. An empty table gives no rows; without training documents the prior
scores. Only the columns named are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.scratch import keep_last, mark, stored
from wayfare.llm.text import chunks

FOLDS, HELD_OUT = 7, 2

# How a word's start is marked in bytes that words do not hold, and in the vocabulary.
MARK = b" "
VOCABULARY_MARK = "▁"
# Tokens that the prior counts as, and the ranks above which its shares fall more slowly.
PRIOR_TOKENS = 1_000.0
RANK_SHIFT = 10
ROUNDS = 3

# A word with more than one in so many of all tokens is sent to every task, so that there are
# fewer of them than that; longer words are joined in any case.
FREQUENT_SHARE = 200_000
FREQUENT_BYTES = 64
# Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 500_000
# Words whose lattices are computed at once, by their bytes.
BATCH_BYTES = 1 << 20

LN10 = math.log(10)
IMPOSSIBLE = -1e300


def pieces(path: str) -> list[tuple[bytes, int]]:
    """Spellings in bytes and ranks of a vocabulary's pieces that lower-cased words can hold.

    Single bytes are always there. A spelling that comes twice keeps its better rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, int] = {}
    for piece in range(model.get_piece_size()):
        if model.is_control(piece) or model.is_unknown(piece) or model.is_unused(piece):
            continue
        text = model.id_to_piece(piece)
        if model.is_byte(piece):
            spelling, rank = bytes([int(text[1:-1], 16)]), model.get_piece_size()
        else:
            spelling = text.replace(VOCABULARY_MARK, MARK.decode()).encode()
            rank = int(-model.get_score(piece))
        usable = MARK not in spelling[1:] and not re.search(rb"[A-Z\x09-\x0D]", spelling)
        if usable and (rank < ranks.get(spelling, rank + 1)):
            ranks[spelling] = rank
    for byte in range(256):
        ranks.setdefault(bytes([byte]), model.get_piece_size())
    return sorted(ranks.items())


def prior(vocabulary: Sequence[tuple[bytes, int]]) -> np.ndarray:
    shares = np.array([1 / (rank + RANK_SHIFT) for _, rank in vocabulary])
    return shares / shares.sum()


class Trie:
    """The spellings as a table of transitions by byte; ``piece`` is -1 between pieces."""

    def __init__(self, spellings: Sequence[bytes]):
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, spelling in enumerate(spellings):
            node = 0
            for byte in spelling:
                child = children[node].get(byte)
                if child is None:
                    child = children[node][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                node = child
            piece[node] = number
        used = sorted({byte for spelling in spellings for byte in spelling[1:]})
        self.column = np.zeros(256, np.int32)  # bytes that only begin pieces lead nowhere
        self.column[used] = np.arange(1, len(used) + 1)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        for node, row in enumerate(children):
            for byte, child in row.items():
                if node:
                    self.next[node, self.column[byte]] = child
        self.first = np.zeros(256, np.int32)
        for byte, child in children[0].items():
            self.first[byte] = child
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, spellings))


@lru_cache(maxsize=2)
def trie(spellings: tuple[bytes, ...]) -> Trie:
    return Trie(spellings)


class Lattices:
    """Arcs of the lattices of some words, laid out one after the other in one row of bytes."""

    def __init__(self, of: Trie, words: Sequence[bytes]):
        text = np.frombuffer(b"".join(MARK + w for w in words) or b"", np.uint8)
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        # each word has a place before its first byte and one after each
        place = np.arange(len(text)) + np.repeat(np.arange(len(words)), self.sizes)
        offset = np.arange(len(text)) - np.repeat(begin[:-1], self.sizes)
        left = np.repeat(begin[1:], self.sizes) - np.arange(len(text))
        self.first = begin[:-1] + np.arange(len(words))
        self.last = self.first + self.sizes
        alive, node = np.arange(len(text)), of.first[text] if len(text) else np.zeros(0, np.int32)
        starts, stops, found, offsets = [], [], [], []
        for length in range(1, of.longest + 1):
            number = of.piece[node]
            hit = number >= 0
            starts.append(place[alive[hit]])
            stops.append(place[alive[hit]] + length)
            offsets.append(offset[alive[hit]])
            found.append(number[hit])
            # on to the next byte, where the word has one
            more = left[alive] > length
            alive, node = alive[more], node[more]
            node = of.next[node, of.column[text[alive + length]]]
            going = node > 0
            alive, node = alive[going], node[going]
            if not len(alive):
                break
        self.start, self.stop, self.piece = map(np.concatenate, (starts, stops, found))
        self.offset = np.concatenate(offsets)
        self.places = len(text) + len(words)

    def _layers(self, key: np.ndarray, target: np.ndarray) -> Iterator[tuple]:
        """Arcs by ``key``, and within it where those of each ``target`` begin."""
        order = np.lexsort((target, key))
        sorted_key, sorted_target = key[order], target[order]
        edges = np.flatnonzero(np.diff(sorted_key)) + 1
        for low, high in zip(np.append(0, edges), np.append(edges, len(order))):
            targets = sorted_target[low:high]
            heads = np.flatnonzero(np.append(True, np.diff(targets) != 0))
            yield order[low:high], heads, targets[heads]

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Log probability of all ways to each place."""
        reach = np.full(self.places, IMPOSSIBLE)
        reach[self.first] = 0.0
        weights = scores[self.piece]
        for arcs, heads, targets in self._layers(self.offset + self.stop - self.start, self.stop):
            reach[targets] = np.logaddexp.reduceat(reach[self.start[arcs]] + weights[arcs], heads)
        return reach

    def backward(self, scores: np.ndarray) -> np.ndarray:
        """Log probability of all ways from each place to the end of its word."""
        reach = np.full(self.places, IMPOSSIBLE)
        reach[self.last] = 0.0
        weights = scores[self.piece]
        for arcs, heads, targets in reversed(list(self._layers(self.offset, self.start))):
            reach[targets] = np.logaddexp.reduceat(reach[self.stop[arcs]] + weights[arcs], heads)
        return reach

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        return self.forward(scores)[self.last]

    def expected(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each taken ``counts`` times."""
        ahead, behind = self.forward(scores), self.backward(scores)
        word = np.searchsorted(self.first, self.start, "right") - 1
        share = ahead[self.start] + scores[self.piece] + behind[self.stop] - ahead[self.last][word]
        return np.bincount(self.piece, counts[word] * np.exp(share), len(scores))


def batches_of(words: Sequence[bytes]) -> Iterator[slice]:
    start = size = 0
    for k, word in enumerate(words):
        size += len(word) + 1
        if size >= BATCH_BYTES:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def fold() -> Column:
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes know no other letters or blanks."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """Each distinct word, how often training documents hold it, and all documents."""

    def table(trained: Counter[bytes], held: Counter[bytes]) -> pa.RecordBatch:
        words = list(trained | held)
        c = [trained[word] for word in words]
        n = [trained[word] + held[word] for word in words]
        columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(c), pa.array(n)]
        return pa.record_batch(columns, ["word", "c", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counter(), Counter()
        for batch in chunks(batches, "text"):
            for text, held in zip(texts_of(batch), batch.column("held_out").to_pylist()):
                counters[held].update(words_of(text))
            if len(counters[0]) + len(counters[1]) > COUNTED_WORDS:
                yield table(*counters)
                counters = Counter(), Counter()
        if any(counters):
            yield table(*counters)

    rows = docs.select("text", (fold() == HELD_OUT).alias("held_out"))
    return (
        rows.mapInArrow(counted, "word string, c long, n long")
        .groupBy("word")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    )


class Model:
    """Log probabilities of pieces, and of the end."""

    def __init__(self, vocabulary: Sequence[tuple[bytes, int]]):
        self.spellings = tuple(spelling for spelling, _ in vocabulary)
        self.prior = prior(vocabulary)
        self.set(np.zeros(len(self.spellings)), 0)

    def set(self, expected: np.ndarray, ends: int) -> None:
        # the end is drawn like a piece; the prior expects it once
        weights = expected + PRIOR_TOKENS * self.prior
        total = weights.sum() + ends + 1
        self.scores = np.log(weights / total)
        self.end = math.log((ends + 1) / total)

    def fit(self, counts: DataFrame, ends: int, rounds: int = ROUNDS) -> Model:
        """Scores from ``counts`` of training words, with columns ``word`` and ``c``."""
        for _ in range(rounds):
            spellings, scores = self.spellings, self.scores

            def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(len(scores))
                for batch in batches:
                    words = [w.encode() for w in batch["word"]]
                    times = batch["c"].to_numpy(np.float64)
                    for part in batches_of(words):
                        lattices = Lattices(trie(spellings), words[part])
                        total += lattices.expected(scores, times[part])
                used = np.flatnonzero(total)
                yield pd.DataFrame({"piece": used, "expected": total[used]})

            found = (
                counts.where("c > 0")
                .select("word", "c")
                .mapInPandas(expected, "piece long, expected double")
                .groupBy("piece")
                .agg(F.sum("expected").alias("expected"))
                .toPandas()  # a row for each piece of the vocabulary at most
            )
            total = np.zeros(len(scores))
            total[found["piece"].to_numpy(np.int64)] = found["expected"]
            self.set(total, ends)
        return self

    def with_marginals(self, words: DataFrame) -> DataFrame:
        """``words`` with the log10 probability of each ``word`` over its segmentations."""
        spellings, scores = self.spellings, self.scores

        @F.pandas_udf("double")
        def marginal(column: pd.Series) -> pd.Series:
            words = [w.encode() for w in column]
            parts = [
                Lattices(trie(spellings), words[part]).marginals(scores)
                for part in batches_of(words)
            ]
            return pd.Series(np.concatenate(parts or [np.zeros(0)]) / LN10)

        return words.withColumn("marginal", marginal("word"))


def score(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: the base score and the log10 probability of the whole text."""
    docs = docs.select("doc_id", "text")
    model = Model(pieces(path))
    since = mark(docs.sparkSession)
    counted = stored(word_counts(docs), "words")
    ends, = docs.agg(F.count_if(fold() != HELD_OUT)).first()
    known, distinct, every = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("n")).first()
    train_tokens = (known or 0) + ends
    unit = math.log10(train_tokens + (distinct or 0) + (1 if ends else 0) + 1)
    scored = stored(model.fit(counted, ends).with_marginals(counted), "scored_words")
    keep_last(docs.sparkSession, since)
    words = scored.select(
        "word",
        "n",
        (F.col("c") > 0).cast("long").alias("known"),
        (F.log10(F.col("c") + F.lit(1)) - F.lit(unit)).alias("base"),
        "marginal",
    )
    common = (
        words.where(F.col("n") * FREQUENT_SHARE > F.lit(every or 0))
        .where(F.octet_length("word") <= FREQUENT_BYTES)
        .drop("n")
    )
    # fewer than FREQUENT_SHARE rows of bounded length
    frequent = {row["word"].encode(): tuple(row)[1:] for row in common.collect()}
    end = (int(ends > 0), math.log10(ends + 1) - unit, model.end / LN10)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row with what its frequent words add up to, and one for each of
        its other words."""
        for batch in chunks(batches, "text"):
            rows: list[int] = []
            words: list[bytes] = []
            times: list[int] = []
            heads: list[int] = []
            sums: list[tuple[int, int, float, float]] = []
            for row, text in zip(batch.column("row").to_pylist(), texts_of(batch)):
                found = words_of(text)
                n, (known, base, marginal) = 1 + len(found), end
                for word, count in Counter(found).items():
                    values = frequent.get(word)
                    if values is None:
                        rows.append(row)
                        words.append(word)
                        times.append(count)
                    else:
                        known += count * values[0]
                        base += count * values[1]
                        marginal += count * values[2]
                # a key of its own that no word has, as words hold no blank
                heads.append(len(rows))
                rows.append(row)
                words.append(b" %d" % row)
                times.append(0)
                sums.append((n, known, base, marginal))
            of_row = np.full(len(rows), -1, np.int64)
            of_row[heads] = np.arange(len(heads))
            place = pa.array(of_row, mask=of_row < 0)
            added = [
                pa.array(column, kind).take(place).fill_null(pa.scalar(0, kind))
                for column, kind in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
            ]
            ids = [batch.column(name).take(place) for name in carried]
            spelled = pa.array(words, pa.binary()).cast(pa.string())
            yield pa.record_batch(
                [*ids, pa.array(rows, pa.int64()), spelled, pa.array(times, pa.int64()), *added],
                [*carried, "row", "word", "times", "n_tokens", "n_known", "base_score", "score"],
            )

    carried = ["doc_id", "held_out"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.withColumns(
        {"held_out": fold() == HELD_OUT, "row": F.monotonically_increasing_id()}
    )
    parts = numbered.mapInArrow(
        split,
        f"doc_id {id_type}, held_out boolean, row long, word string, times long, "
        "n_tokens long, n_known long, base_score double, score double",
    )

    def added(name: str, each: str, kind: str) -> Column:
        zero = F.lit(0).cast(kind)
        return F.sum(F.col(name) + F.col("times") * F.coalesce(each, zero)).alias(name)

    return (
        parts.join(words.drop("n"), "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum(F.col("n_tokens")).alias("n_tokens"),
            added("n_known", "known", "bigint"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            added("base_score", "base", "double"),
            added("score", "marginal", "double"),
        )
        .drop("row")
    )
