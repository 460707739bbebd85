"""Language identification by interpolated Kneser-Ney models of characters.

Texts are lower-cased and everything between letters becomes one space. For each language
the probability of a character after the ``ORDER - 1`` before it is interpolated Kneser-Ney:
absolute discounting, with continuation counts below the highest order. A model holds, per
order, the sorted hashes of the n-grams of all languages and a row of log probabilities for
each; a text is scored by binary search, and an n-gram no language has backs off with the
weight of its context, itself in a sorted array. The language of lowest cross-entropy per
character wins. A text is accepted if that is no higher than almost all texts of the
language and about its length had in a calibration sample, by a margin. Where the sample has
too few texts of a length, spans of whole words cut from its texts stand in for them; what
is missing then comes from the nearest length, the longer first, or else from all languages.

Training reads a bounded sample: documents by hash of their id, about ``SAMPLE_CHARS`` code
points per language, of which ``CALIBRATION_SHARE`` are not counted but set the limits. The
counts are made by Spark; the sample bounds the model's size, so it is broadcast. Every
document is scored whole.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0 and not
accepted; so is every text if no row with a language is there to learn from. Ties go to the
first language in code point order. Rows are scored one by one, so repeated rows agree. A
NULL id is not held out, and not learned from either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.text import chunks

ORDER = 4
UNKNOWN = "und"

# Code points per language to learn from, on average, and the share of them to set limits by.
SAMPLE_CHARS = 3_000_000
CALIBRATION_SHARE = 0.3
# Limits hold for texts with at least so many letters; each is a quantile times a margin.
LENGTHS = (1, 16, 64, 256)
QUANTILE = 0.999
MARGIN = 1.6
LEAST_TEXTS = 50
# Spans cut from a calibration text for each class of lengths, at most.
SPANS = 16

FOLDS = 5
# Characters scored at a time.
SPAN = 1 << 19
# Fixed value: an odd multiplier for hashes of n-grams.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
# Fixed value: the golden ratio's fraction, whose multiples spread evenly.
GOLDEN = 0.6180339887498949


def fold(doc_id: Column) -> Column:
    """0 for held-out documents; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Code points of a text as the models see them, after ``ORDER - 1`` spaces."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    points = np.where(_letters()[points], points, SPACE)
    kept = np.ones(len(points), bool)
    if len(points):
        kept[0] = points[0] != SPACE
        kept[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    padding = np.full(ORDER - 1, SPACE, np.uint64)
    return np.concatenate([padding, points[kept].astype(np.uint64)])


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of n-grams given column by column."""
    if not columns:
        return np.zeros(0, np.uint64)
    total = columns[0]
    for column in columns[1:]:
        total = total * MULTIPLIER + column
    return total


def _windows(points: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each character after the padding."""
    first = ORDER - order
    end = len(points) - order + 1
    return _hash([points[first + k : end + k] for k in range(order)])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether what stands there is what was wanted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    places = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return places, keys[places] == wanted


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order - 1, sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)  # rows as grams, columns as languages
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None  # of a character no language has
    limits: np.ndarray | None = None  # rows as LENGTHS

    def entropies(self, points: np.ndarray) -> np.ndarray:
        """Sum of -log2 p over a text's characters, by language."""
        total = np.zeros(len(self.languages))
        for start in range(ORDER - 1, len(points), SPAN):
            span = points[start - ORDER + 1 : start + SPAN]
            total += self.scores(span).sum(axis=0, dtype=np.float64)
        return -total

    def scores(self, points: np.ndarray) -> np.ndarray:
        """log2 p of each character after the padding, by language."""
        hashes = _windows(points, ORDER)
        places, known = _find(self.grams[-1], hashes)
        found = self.logs[-1][places]
        rest = np.flatnonzero(~known)
        if len(rest):
            found[rest] = self._backed_off(points, rest)
        return found

    def _backed_off(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As ``scores``, for some characters whose n-gram of the highest order is new."""
        total = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            ends = at[open_] + ORDER - 1
            columns = [points[ends - k] for k in range(order - 1, -1, -1)]
            if order < ORDER:
                places, known = _find(self.grams[order - 1], _hash(columns))
                total[open_[known]] += self.logs[order - 1][places[known]]
                open_ = open_[~known]
                columns = [c[~known] for c in columns]
            if not len(open_):
                return total
            if order > 1:
                places, known = _find(self.contexts[order - 1], _hash(columns[:-1]))
                total[open_[known]] += self.backoffs[order - 1][places[known]]
        total[open_] += self.unseen
        return total

    def limit(self, language: int, letters: int) -> float:
        return self.limits[np.searchsorted(LENGTHS, letters, "right") - 1, language]


def fitted(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from each language's n-grams of the highest order: code points and counts."""
    model = Model(languages)
    size = len(languages)
    alphabet = np.unique(np.concatenate([grams[:, -1] for grams, _ in counts]))
    below = np.full((1, size), 1 / (len(alphabet) + 1))
    model.unseen = None
    tables = []  # by language: rows and weights, from the highest order down
    for grams, weight in counts:
        table = [(grams, weight.astype(np.float64))]
        for _ in range(ORDER - 1):
            rows, inverse = np.unique(table[-1][0][:, 1:], axis=0, return_inverse=True)
            table.append((rows, np.bincount(inverse.ravel(), minlength=len(rows)).astype(np.float64)))
        tables.append(table)
    lower_keys = np.zeros(0, np.uint64)
    for order in range(1, ORDER + 1):
        level = [table[ORDER - order] for table in tables]
        columns = [[rows[:, k] for k in range(order)] for rows, _ in level]
        hashes = [_hash(c) for c in columns]
        keys, first = np.unique(np.concatenate(hashes), return_index=True)
        everyone = np.concatenate([rows for rows, _ in level])[first]
        head = [_hash(c[:-1]) if order > 1 else np.zeros(len(h), np.uint64) for c, h in zip(columns, hashes)]
        contexts = np.unique(np.concatenate(head))
        seen = np.zeros((len(keys), size))
        backoff = np.ones((len(contexts), size))
        for lang, (_, weight) in enumerate(level):
            discount = _discount(weight)
            place = np.searchsorted(contexts, head[lang])
            mass = np.bincount(place, weight, len(contexts))
            kinds = np.bincount(place, minlength=len(contexts))
            has = mass > 0
            backoff[has, lang] = discount * kinds[has] / mass[has]
            seen[np.searchsorted(keys, hashes[lang]), lang] = (weight - discount) / mass[place]
        every = [everyone[:, k] for k in range(order)]
        of_context = np.searchsorted(contexts, _hash(every[:-1])) if order > 1 else np.zeros(len(keys), int)
        of_lower = np.searchsorted(lower_keys, _hash(every[1:])) if order > 1 else np.zeros(len(keys), int)
        if order == 1:
            model.unseen = np.log2(backoff[0] * below[0]).astype(np.float32)
        below = seen + backoff[of_context] * below[of_lower]
        lower_keys = keys
        model.grams.append(keys)
        model.logs.append(np.log2(below).astype(np.float32))
        model.contexts.append(contexts)
        model.backoffs.append(np.log2(backoff).astype(np.float32))
    return model


def _discount(weight: np.ndarray) -> float:
    once, twice = (weight == 1).sum(), (weight == 2).sum()
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.1, 0.9))


def _place() -> Column:
    """A number from 0 to 1 by hash of the id."""
    return F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)


def _counted(sample: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and ``n``: the n-grams of the highest order in a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "text"):
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                texts.setdefault(lang, []).append(symbols(text))
            for lang, parts in texts.items():
                points = np.concatenate(parts)
                hashes = np.concatenate([_windows(p, ORDER) for p in parts])
                ends = np.concatenate(
                    [np.arange(ORDER - 1, len(p)) + base for p, base in zip(parts, _bases(parts))]
                )
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                grams = np.stack([points[ends[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1)
                raw = grams.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()),
                        pa.array([raw[k * ORDER : (k + 1) * ORDER] for k in range(len(n))], pa.string()),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _bases(parts: list[np.ndarray]) -> np.ndarray:
    lengths = [len(p) for p in parts]
    return np.cumsum([0, *lengths[:-1]])


def train(docs: DataFrame) -> Model | None:
    """A model of every non-NULL ``lang`` in rows outside the held-out fold; None without any."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    shares = sizes.select("lang", F.least(F.lit(1.0), SAMPLE_CHARS / F.greatest("chars", F.lit(1))).alias("share"))
    share = {r["lang"]: r["share"] for r in shares.collect()}
    if not share:
        return None
    by_lang = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(s))])
    of_lang = by_lang[F.col("lang")]
    split = of_lang * (1 - CALIBRATION_SHARE)
    table = _counted(rows.where(_place() < split)).toArrow().to_pandas()
    languages, counts = [], []
    for lang, part in sorted(table.groupby("lang"), key=lambda x: x[0].encode()):
        raw = "".join(part["gram"]).encode("utf-32-le", "surrogatepass")
        grams = np.frombuffer(raw, np.uint32).reshape(-1, ORDER).astype(np.uint64)
        order = np.lexsort(grams.T[::-1])  # sums in a fixed order
        languages.append(lang)
        counts.append((grams[order], part["n"].to_numpy()[order]))
    if not languages:
        return None
    model = fitted(languages, counts)
    apart = rows.where((_place() >= split) & (_place() < of_lang)).select("lang", "text")
    model.limits = _limits(model, _measured(apart, model).toArrow().to_pandas())
    return model


def cuts(points: np.ndarray) -> Iterator[np.ndarray]:
    """Spans of whole words of a text, spread over it and over each class of lengths."""
    letter = points != SPACE
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.append(starts[1:], len(points))
    before = np.append(0, np.cumsum(letter))[np.append(starts, len(points))]
    for k, least in enumerate(LENGTHS):
        widest = LENGTHS[k + 1] / least if k + 1 < len(LENGTHS) else LENGTHS[-1] / LENGTHS[-2]
        first = 0
        for span in range(SPANS):
            first = max(first, span * len(starts) // SPANS)
            wanted = least * widest ** (span * GOLDEN % 1)
            last = int(np.searchsorted(before, before[first] + wanted))
            if last > len(starts):
                break
            yield np.concatenate([points[: ORDER - 1], points[starts[first] : ends[last - 1]]])
            first = last


def _measured(apart: DataFrame, model: Model) -> DataFrame:
    """``lang``, ``letters``, ``entropy`` and ``whole`` of texts and spans found to be of their language."""
    shared = apart.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in chunks(batches, "text"):
            found = []
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                whole = symbols(text)
                for points in (whole, *cuts(whole)):
                    best, _, letters, entropy, _ = _judged_points(model, points)
                    if best == lang and letters:
                        found.append((lang, letters, entropy, points is whole))
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.bool_()]
            columns = zip(*found) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["lang", "letters", "entropy", "whole"],
            )

    fields = "lang string, letters long, entropy double, whole boolean"
    return apart.select("lang", "text").mapInArrow(run, fields)


def _limits(model: Model, measured) -> np.ndarray:
    """Highest cross-entropy accepted, by least number of letters and language."""
    limits = np.stack(
        [_of_lengths(measured[measured["lang"] == name]) for name in model.languages], axis=1
    )
    everyone = _of_lengths(measured)
    limits = np.where(np.isnan(limits), everyone[:, None], limits)
    limits = np.where(np.isnan(limits), np.inf, limits)
    # a shorter text never has a lower limit
    return np.maximum.accumulate(limits[::-1], axis=0)[::-1]


def _of_lengths(measured) -> np.ndarray:
    """Limits by class of lengths, from the nearest class where one has too few; NaN if all have."""
    letters, entropy = measured["letters"].to_numpy(), measured["entropy"].to_numpy()
    whole = measured["whole"].to_numpy().astype(bool)
    limits = np.full(len(LENGTHS), np.nan)
    for k, least in enumerate(LENGTHS):
        upper = LENGTHS[k + 1] if k + 1 < len(LENGTHS) else np.inf
        of_length = (letters >= least) & (letters < upper)
        if (of_length & whole).sum() >= LEAST_TEXTS:
            of_length &= whole
        if of_length.sum() >= LEAST_TEXTS:
            limits[k] = np.quantile(entropy[of_length], QUANTILE) * MARGIN
    known = np.flatnonzero(~np.isnan(limits))
    for k in np.flatnonzero(np.isnan(limits)) if len(known) else ():
        limits[k] = limits[known[known > k][0] if (known > k).any() else known[-1]]
    return limits


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without ``text``, with ``best``, ``score``, ``letters``, ``entropy``, ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in chunks(batches, "text"):
            judged = [_judged(model, text) for text in rows.column("text").to_pylist()]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            added = [pa.array(c, k) for c, k in zip(zip(*judged), kinds)]
            kept = [rows.column(f.name) for f in others]
            names = [f.name for f in others]
            yield pa.RecordBatch.from_arrays(
                [*kept, *added], names=[*names, "best", "score", "letters", "entropy", "accepted"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    added = "best string, score double, letters long, entropy double, accepted boolean"
    return docs.select(*[f.name for f in others], "text").mapInArrow(run, f"{fields}, {added}")


def _judged(model: Model | None, text: str | None) -> tuple:
    return _judged_points(model, symbols(text))


def _judged_points(model: Model | None, points: np.ndarray) -> tuple:
    letters = int((points != SPACE).sum())
    if model is None or not letters:
        return UNKNOWN, 0.0, letters, None, False
    bits = model.entropies(points)
    best = int(bits.argmin())
    entropy = bits[best] / (len(points) - ORDER + 1)
    score = 1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum()
    accepted = model.limits is None or entropy <= model.limit(best, letters)
    return model.languages[best], float(score), letters, float(entropy), bool(accepted)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` and more."""
    model = train(docs) if model is None else model
    rows = docs.select("doc_id", "text")
    return _scored(rows, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("best").alias("lang_pred"),
        "score",
        "accepted",
        F.col("entropy").alias("cross_entropy"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of the languages learned from them."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "text"):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            yield rows.filter(pa.array([_judged(shared.value, t)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
