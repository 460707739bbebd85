"""Quality rules as a short-circuit cascade ordered by measured cost and selectivity.

A rule is a condition on a few metrics of a text. ``plan`` measures on a bounded sample what
each rule costs and which rows it rejects, and orders the rules by rejected rows per second.
``judge`` then evaluates them in that order; the metrics of a rule are computed only for rows
that all earlier rules let pass. The order changes the cost alone: a row is kept if no rule
rejects it, whichever comes first. Everything is built-in column functions.

Defined cases: a NULL text counts as empty, and an empty text has no words and fails the
base rule. Repeated rows are judged alike, each on its own. Columns of the input keep their
values whatever they are called; metrics live in a column of their own until the end.

Repeated windows of five words are found by a 64-bit hash of the words.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm import text as tx
from wayfare.session import is_plain_scan

WINDOW = 5

# Thresholds of the rules.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MAX_SYMBOLS_PERCENT = 30
MAX_EXCLAMATIONS_PERCENT = 50
MAX_UPPER_PERCENT = 50
MAX_DUPLICATE_LINES_PERCENT = 30
WORD_CHARS = (2, 15)

# Rows of the sample that orders the rules, the longest text in it, and how often each rule
# is timed. It decides about speed only.
SAMPLE_ROWS = 256
SAMPLE_TEXT_BYTES = 64 * 1024
REPEATS = 2
# Least time that a rule counts as, since shorter ones cannot be told apart.
LEAST_SECONDS = 2e-3

Get = Callable[[str], Column]
Metric = Callable[[Get], Column]


def _word_chars(c: Get) -> Column:
    return F.length(F.array_join(c("words"), "")).cast("bigint")


def _count_of(characters: str) -> Metric:
    """Number of code points in a class of characters."""
    return lambda c: F.length(F.regexp_replace(c("text"), f"[^{characters}]+", "")).cast("bigint")


def _lines(c: Get) -> Column:
    has_word = lambda line: F.btrim(line, F.lit(tx.SPACES)) != ""
    return F.filter(F.split(c("text"), "\n"), has_word)


def _windows(c: Get) -> Column:
    hashes = c("hashes")
    last = F.size(hashes) - F.lit(WINDOW)
    hashed = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.get(hashes, i), *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    )
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _ranked(c: Get) -> Column:
    """Windows in order of hash and place; an empty array where no window comes twice."""
    windows = c("windows")
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, F.sort_array(placed)).otherwise(none)


def _starts(c: Get) -> Column:
    """Places, in order, of the windows that stand beside an equal one in ``ranked``."""
    ranked = c("ranked")

    def place(x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(ranked, j - 1)["h"] == x["h"])
        after = F.get(ranked, j + 1)["h"] == x["h"]
        equal = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
        return F.when(equal, x["i"])

    return F.sort_array(F.array_compact(F.transform(ranked, place)))


def _covered(c: Get) -> Column:
    """Words in any of the windows: each adds the words that the one before did not have."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))

    def add(acc: Column, i: Column) -> Column:
        new = F.least(F.lit(WINDOW), i - acc["last"])
        return F.struct((acc["n"] + new).alias("n"), i.alias("last"))

    return F.aggregate(c("starts"), start, add, lambda acc: acc["n"])


# Every metric, after those that it is made from.
METRICS: dict[str, tuple[tuple[str, ...], Metric]] = {
    "words": (("text",), lambda c: tx.words(c("text"))),
    "n_words": (("words",), lambda c: F.size(c("words")).cast("bigint")),
    "word_chars": (("words",), _word_chars),
    "n_symbols": (("text",), _count_of(r"#*$%&|<>")),
    "n_exclamations": (("text",), _count_of("!?")),
    "n_upper": (("text",), _count_of(r"\p{Lu}")),
    "lines": (("text",), _lines),
    "n_lines": (("lines",), lambda c: F.size(c("lines")).cast("bigint")),
    "n_dup_lines": (
        ("lines",),
        lambda c: (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("bigint"),
    ),
    "hashes": (("words",), lambda c: F.transform(c("words"), lambda w: F.xxhash64(w))),
    "windows": (("hashes",), _windows),
    "ranked": (("windows",), _ranked),
    "starts": (("ranked",), _starts),
    "n_repeat_words": (("starts",), _covered),
}


# What metrics are made from, besides numbers.
WORKING = frozenset(["text", "words", "lines", "hashes", "windows", "ranked", "starts"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that the rule throws out, given its ``metrics``."""

    name: str
    metrics: tuple[str, ...]
    rejects: Callable[[Get], Column]


def _above(part: str, percent: int, whole: str) -> Callable[[Get], Column]:
    return lambda c: F.lit(100) * c(part) > F.lit(percent) * c(whole)


FEW_WORDS = Rule("few_words", ("n_words",), lambda c: c("n_words") < MIN_WORDS)
REPEATED = Rule(
    "repeated_words",
    ("n_words", "n_repeat_words"),
    _above("n_repeat_words", MAX_REPEATED_PERCENT, "n_words"),
)
BASE = (FEW_WORDS, REPEATED)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), _above("n_symbols", MAX_SYMBOLS_PERCENT, "n_words")),
    Rule(
        "exclamations",
        ("n_words", "n_exclamations"),
        _above("n_exclamations", MAX_EXCLAMATIONS_PERCENT, "n_words"),
    ),
    Rule("upper_case", ("word_chars", "n_upper"), _above("n_upper", MAX_UPPER_PERCENT, "word_chars")),
    Rule(
        "duplicate_lines",
        ("n_lines", "n_dup_lines"),
        _above("n_dup_lines", MAX_DUPLICATE_LINES_PERCENT, "n_lines"),
    ),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda c: (c("word_chars") < F.lit(WORD_CHARS[0]) * c("n_words"))
        | (c("word_chars") > F.lit(WORD_CHARS[1]) * c("n_words")),
    ),
)

PREFIX = "_quality_"
STATE = PREFIX + "state"


def _get(name: str) -> Column:
    return F.col(STATE)[name]


def _needed(metrics: Iterable[str], have: Iterable[str]) -> list[list[str]]:
    """Layers of missing metrics; those of a layer only need earlier layers."""
    wanted, stack = set(), list(metrics)
    while stack:
        name = stack.pop()
        if name not in have and name not in wanted:
            wanted.add(name)
            stack += METRICS[name][0]
    layers: list[list[str]] = []
    done = set(have)
    while wanted:
        ready = sorted(m for m in wanted if done.issuperset(METRICS[m][0]))
        layers.append(ready)
        done |= set(ready)
        wanted -= set(ready)
    return layers


class State:
    """What is known of a text, as one expression.

    It is a struct that is alone in an array, and each step is a ``transform`` of that array:
    the steps before are bound to the one name of its element. However often a step refers to
    them, the expression holds each step once, so that it stays as long as the cascade also
    where the optimizer copies it into a filter.
    """

    def __init__(self, text: str):
        self.fields = ["text"]
        self.column = F.array(F.struct(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))

    def add(self, made: dict[str, Metric]) -> None:
        kept = [f for f in self.fields if f not in made]

        def step(element: Column) -> Column:
            get = element.getField
            return F.struct(
                *[get(f).alias(f) for f in kept], *[make(get).alias(f) for f, make in made.items()]
            )

        self.column = F.transform(self.column, step)
        self.fields = [*kept, *made]

    def measure(self, metrics: Iterable[str], alive: str | None = None) -> None:
        """More metrics; where the field ``alive`` is false they are NULL and cost nothing."""

        def guarded(metric: Metric) -> Metric:
            return lambda c: F.when(c(alive), metric(c))

        for layer in _needed(metrics, self.fields):
            made = {m: METRICS[m][1] for m in layer}
            self.add({m: guarded(f) for m, f in made.items()} if alive else made)

    def on(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the state's numbers and verdicts; text and arrays, which are many times
        as large, do not leave the expression."""
        names = [f for f in self.fields if f not in WORKING]

        def numbers(element: Column) -> Column:
            return F.struct(F.lit(True).alias("known"), *[element[f].alias(f) for f in names])

        return docs.withColumn(STATE, F.get(F.transform(self.column, numbers), F.lit(0)))


def _rejects(rule: Rule) -> Metric:
    return lambda c: F.coalesce(rule.rejects(c), F.lit(False))


@dataclass(frozen=True)
class Step:
    """A rule, what its metrics cost on the sample, and the share of its rows that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, LEAST_SECONDS)


def _sample(docs: DataFrame, text: str) -> DataFrame:
    """Up to ``SAMPLE_ROWS`` texts of bounded length.

    Of a plain table only one file is read, the rest of a plan has to be counted first; either
    way the share taken follows from the number of rows, so that no more are kept.
    """
    column = f"`{text}`"
    if is_plain_scan(docs):
        files = sorted(docs.inputFiles(), key=lambda name: crc32(name.encode()))
        docs = docs.sparkSession.read.schema(docs.schema).parquet(*files[:1]) if files else docs
    short = F.coalesce(F.octet_length(column), F.lit(0)) <= SAMPLE_TEXT_BYTES
    texts = docs.select(F.col(column).alias("text")).where(short)
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    return texts.sample(share, seed=1).coalesce(1)


def _timer(sample: DataFrame) -> Callable[[Iterable[str]], float]:
    """How long the sample takes with some metrics: the fastest of the repeats, after one run
    that compiles. Each set of metrics is timed once."""

    @cache
    def seconds(metrics: frozenset[str]) -> float:
        state = State("text")
        state.measure(metrics)
        made = sorted(metrics) or ["text"]
        state.add({"made": lambda c: reduce(Column.__and__, [c(m).isNotNull() for m in made])})
        job = state.on(sample).agg(F.count_if(_get("made")))
        runs = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            job.collect()
            runs.append(time.perf_counter() - start)
        return min(runs[1:])

    return lambda metrics: seconds(frozenset(metrics))


def _rule_seconds(timed: Callable[[Iterable[str]], float], rule: Rule, have: set[str]) -> float:
    """What a rule's metrics take beyond those in ``have`` that they are made from."""
    missing = [m for layer in _needed(rule.metrics, have) for m in layer]
    if not missing:
        return 0.0
    below = {b for m in missing for b in METRICS[m][0] if b in have and b != "text"}
    return max(timed(missing) - timed(below), 0.0)


def plan(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    report: Sequence[str] = (),
) -> list[Step]:
    """The rules by falling rejection per cost, both measured on about ``SAMPLE_ROWS`` rows.

    A rule costs what its metrics take; those in ``report`` are computed anyway and cost
    nothing. Ties keep the order given, as does a table without rows.
    """
    sample = _sample(docs, text).cache()
    try:
        state = State("text")
        state.measure(m for rule in rules for m in rule.metrics)
        verdicts = F.array(*[F.when(_rejects(r)(_get), F.lit(k)) for k, r in enumerate(rules)])
        by = F.array_compact(verdicts).alias("by")
        found = list(map(tuple, state.on(sample).groupBy(by).count().collect())) if rules else []
        if not found:
            return [Step(rule, 0.0, 0.0) for rule in rules]
        have = {"text"}.union(*_needed(report, ["text"]))
        timed = _timer(sample)
        costs = [_rule_seconds(timed, rule, have) for rule in rules]
    finally:
        sample.unpersist()

    rows = sum(n for _, n in found)
    rejected = [sum(n for by, n in found if k in by) / rows for k in range(len(rules))]
    steps = map(Step, rules, costs, rejected)
    return sorted(steps, key=lambda step: -step.rank)


def judge(
    docs: DataFrame,
    text: str = "text",
    steps: Sequence[Step] | None = None,
    report: Sequence[str] = (),
) -> tuple[DataFrame, Column]:
    """``docs`` with a working column, and the column that is true for rows to keep.

    ``report`` names metrics wanted for every row; they are computed first, and rules on
    them cost nothing more.
    """
    steps = plan(docs, text, report=report) if steps is None else steps
    state = State(text)
    state.measure(report)
    alive = None
    for step in steps:
        state.measure(step.rule.metrics, alive)
        rejects = _rejects(step.rule)
        if alive:
            state.add({"alive": lambda c, rejects=rejects: c("alive") & ~rejects(c)})
        else:
            state.add({"alive": lambda c, rejects=rejects: ~rejects(c)})
        alive = "alive"
    if not alive:
        state.add({"alive": lambda c: F.lit(True)})
    return state.on(docs), _get("alive")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with the columns of ``docs``.

    A filter moved below the verdict would compute it there; the number of the row, which is
    not deterministic, keeps it above, so that the verdict is computed once.
    """
    judged, alive = judge(docs, text)
    numbered = judged.withColumn(f"{PREFIX}row", F.monotonically_increasing_id())
    kept = numbered.where(alive & (F.col(f"{PREFIX}row") >= 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: the base metrics, the base verdict and the whole verdict."""
    judged, alive = judge(docs.select("doc_id", "text"), report=REPORTED)
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.rejects(_get)
    return judged.select(
        "doc_id",
        *[_get(m).alias(m) for m in REPORTED],
        base.alias("base_failed"),
        alive.alias("kept"),
    )


QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), grams AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_exclamations,
    length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper,
    len(lines) AS n_lines
  FROM w LEFT JOIN repeats USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > {MAX_SYMBOLS_PERCENT} * n_words
    OR 100 * n_exclamations > {MAX_EXCLAMATIONS_PERCENT} * n_words
    OR 100 * n_upper > {MAX_UPPER_PERCENT} * word_chars
    OR 100 * n_dup_lines > {MAX_DUPLICATE_LINES_PERCENT} * n_lines
    OR word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words) AS kept
FROM b
"""
