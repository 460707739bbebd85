"""Mixing sources to target weights on a low-discrepancy schedule.

The words of a source, its documents shuffled by a hash, form a stream that is cut into
blocks of equally many words, in a small source into smaller ones. Slot ``i`` of the schedule holds the golden-ratio point
``frac(i * phi)``; the interval of cumulated target shares that the point falls into names
the source, and the slot's rank within its source names the block, again from the first one
when all are used. As the points have low discrepancy, every stretch of the schedule, not
only the whole, holds the sources in their target shares. All of it is built-in functions.

Targets: the sources in code point order, NULL last, weigh 5, 2, 1, 5, 2, 1, ... and share
the number of all words; a target stops at ``MAX_EPOCHS`` times the words of its source, and
what that leaves over is shared among the others by weight.

A source's blocks are a ``SOURCE_BLOCKS``-th of it, of ``BLOCK_WORDS`` words at most and one at
least, and its share of the slots is its target in blocks. Sources thus come near their
targets whatever their own size and that of the corpus.

Defined cases: a NULL text or one without a word has size 0 and nothing is taken from it; a
NULL source is a source of its own, last in order. Repeated rows, also those with equal ids,
each count. An empty table gives an empty result. Reruns give the same rows: the shuffle is
a hash of id and text, and rows that agree in both are interchangeable. Columns of the input
other than those named are neither read nor changed by ``taken``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm import text as tx
from wayfare.llm.prefix import totals_before
from wayfare.llm.scratch import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3

# Words of a block, at most, and blocks of a source, at least, if it has as many words.
BLOCK_WORDS = 128
SOURCE_BLOCKS = 1 << 10
# A source's share of the slots is a whole number of such parts of a slot, which add up exactly.
SLOT_PARTS = 1 << 10

# Fixed value: the golden ratio's fraction as a 32-bit multiplier.
GOLDEN = 2654435769
POINTS = 1 << 32

# Rows that share a bucket of the running totals.
BUCKET_ROWS = 256
KEY_BITS = 60
# Cells over which sources' intervals and points meet in an equality join.
CELL_BITS = 20


@dataclass(frozen=True)
class Corpus:
    """Sizes of the documents as a written table, and what the driver knows of them."""

    sizes: DataFrame
    rows: int
    words: int


def measured(docs: DataFrame) -> Corpus:
    """``doc_id``, ``source``, ``size`` and place in the shuffle of every document, written."""
    sizes = stored(
        docs.select(
            "doc_id",
            "source",
            _stream().alias("stream"),
            F.size(tx.words(F.col("text"))).cast("bigint").alias("size"),
            _place().alias("place"),
        ),
        "sizes",
    )
    rows, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return Corpus(sizes, rows, words)


def targets(corpus: Corpus) -> DataFrame:
    """Per source: ``stream``, ``source``, ``source_size``, ``target`` and ``block_words``, in words.

    Sources in rising order of cap per weight reach their caps first. Of the words and the
    weight that remain after the sources before, each takes its share by weight or, if that
    is less, its cap; from the first that takes its share on, all do, at the same rate.
    """
    sources = corpus.sizes.groupBy("stream", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = sources.withColumn(
        "weight",
        F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))).cast("bigint"),
    ).withColumn("cap", F.col("source_size") * MAX_EPOCHS)

    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(up_to), F.lit(0))
    everything = Window.partitionBy()
    left = weighed.withColumns(
        {
            "words_left": F.lit(corpus.words) - earlier("cap"),
            "weight_left": F.sum("weight").over(everything) - earlier("weight"),
        }
    )
    shared = F.col("words_left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    rate = F.struct("words_left", "weight_left")
    of_source = F.greatest(F.lit(1), F.floor(F.col("source_size") / SOURCE_BLOCKS))
    block = F.least(F.lit(BLOCK_WORDS), of_source)
    so_far = by_cap.rowsBetween(Window.unboundedPreceding, 0)
    rated = left.withColumn("rate", F.first(F.when(shared, rate), ignorenulls=True).over(so_far))
    return rated.select(
        "stream",
        "source",
        "source_size",
        F.when(
            F.col("rate").isNull() | (F.col("rate.weight_left") == 0),
            F.col("cap").cast("double"),
        )
        .otherwise(
            F.col("rate.words_left").cast("double")
            * F.col("weight").cast("double")
            / F.col("rate.weight_left").cast("double")
        )
        .alias("target"),
        block.cast("bigint").alias("block_words"),
    )


def _points(slots: int, spark) -> DataFrame:
    """Golden-ratio points of all slots in 32 bits; halves keep the product in range."""
    low, high = F.col("slot") % 65536, F.shiftright(F.col("slot"), 16) % 65536
    point = ((high * GOLDEN % 65536) * 65536 + low * GOLDEN) % POINTS
    return spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point)


def schedule(goals: DataFrame) -> DataFrame:
    """``slot``, ``stream``, ``block`` and ``epoch``: what the mix consists of, in order.

    A source that has been used ``MAX_EPOCHS`` times gets no further slots.
    """
    cell = lambda c: F.shiftright(c, CELL_BITS)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    parts = F.round(F.col("target") / F.col("block_words") * SLOT_PARTS).cast("bigint")
    shares = goals.where("target > 0").withColumn("share", parts)
    total = shares.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    so_far = F.sum("share").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    bounds = shares.withColumn(
        "upper", F.round(so_far.cast("double") / F.lit(float(total or 1)) * POINTS).cast("bigint")
    )
    intervals = bounds.withColumn(
        "lower", F.coalesce(F.lag("upper").over(by_name), F.lit(0))
    ).where("upper > lower")
    cells = intervals.select(
        "stream",
        "source_size",
        "block_words",
        "lower",
        "upper",
        F.explode(F.sequence(cell(F.col("lower")), cell(F.col("upper") - 1))).alias("cell"),
    )
    points = _points(-(-total // SLOT_PARTS), goals.sparkSession).withColumn("cell", cell(F.col("point")))
    inside = (F.col("point") >= F.col("lower")) & (F.col("point") < F.col("upper"))
    named = points.join(cells, "cell").where(inside).select("slot", "stream", "source_size", "block_words")
    ranked = totals_before(
        named.withColumn("one", F.lit(1).cast("bigint")),
        ["stream"],
        F.floor(F.col("slot") / BUCKET_ROWS),
        [F.col("slot")],
        "one",
        "rank",
    )
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    return ranked.select(
        "slot",
        "stream",
        (F.col("rank") % blocks).alias("block"),
        F.floor(F.col("rank") / blocks).alias("epoch"),
    ).where(F.col("epoch") < MAX_EPOCHS)


def streams(corpus: Corpus) -> DataFrame:
    """Documents with ``start``, the words of their source's shuffled stream before them."""
    bits = max(0, min(KEY_BITS, (corpus.rows // BUCKET_ROWS).bit_length()))
    order = ["place", "doc_id", "size"]
    return totals_before(
        corpus.sizes,
        ["stream"],
        F.shiftright(F.col("place"), KEY_BITS - bits),
        [F.col(c) for c in order],
        "size",
        "start",
    )


def taken(corpus: Corpus, goals: DataFrame) -> DataFrame:
    """Per document of size over 0 its words in the mix, as often as they come there."""
    block = F.col("block_words")
    end = F.col("start") + F.col("size")
    pieces = (
        streams(corpus)
        .where("size > 0")
        .join(goals.select("stream", "block_words"), "stream")
        .select(
            "*",
            F.explode(
                F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
            ).alias("block"),
        )
        .withColumn(
            "words",
            F.least(end, (F.col("block") + 1) * block)
            - F.greatest(F.col("start"), F.col("block") * block),
        )
    )
    uses = schedule(goals).groupBy("stream", "block").agg(F.count(F.lit(1)).alias("uses"))
    return (
        pieces.join(uses, ["stream", "block"], "left")
        .groupBy("doc_id", "stream", "place", "start", "size")
        .agg(F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``."""
    corpus = measured(docs)
    goals = stored(targets(corpus), "targets")
    empty = corpus.sizes.where("size = 0").select("doc_id", "stream", "size", F.lit(0).alias("taken"))
    rows = taken(corpus, goals).select("doc_id", "stream", "size", "taken").unionByName(empty)
    return rows.join(goals, "stream").select("doc_id", "size", "source_size", "target", "taken")


def _place() -> Column:
    """Place of a document in the shuffle: a hash of its id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(marked), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _stream() -> Column:
    """Name of a document's source in joins, where a NULL source has to meet itself."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it was taken.

    The last use of a source may end inside a document, which then comes with its first
    words only, joined by spaces and with ``n_chars`` to match. Rows with equal id, source and text
    are one document that is taken as often as all of them.
    """
    corpus = measured(docs)
    goals = stored(targets(corpus), "targets")
    key = ["place", "doc_id", "stream"]
    portions = stored(
        taken(corpus, goals)
        .groupBy(*key)
        .agg(
            F.sum(F.floor(F.col("taken") / F.col("size"))).alias("whole"),
            F.sum(F.col("taken") % F.col("size")).alias("rest"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where("whole > 0 OR rest > 0"),
        "portions",
    )
    portions = portions.select([F.col(c).alias(f"_mix_{c}") for c in portions.columns])
    names = docs.columns
    marked = docs.withColumns({"_mix_at": _place(), "_mix_of": _stream()})
    if not portions.where("_mix_rows > 1").isEmpty():
        marked = marked.dropDuplicates(["_mix_at", "_mix_of", "doc_id"])
    same = (
        (F.col("_mix_at") == F.col("_mix_place"))
        & (F.col("_mix_of") == F.col("_mix_stream"))
        & F.col("doc_id").eqNullSafe(F.col("_mix_doc_id"))
    )
    last = F.col("_mix_whole") - F.when(F.col("_mix_rest") > 0, 0).otherwise(1)
    uses = marked.join(portions, same).withColumn(
        "_mix_use", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    partial = F.col("_mix_use") == F.col("_mix_whole")
    start = F.slice(tx.words(F.col("text")), F.lit(1), F.col("_mix_rest").cast("int"))
    cut = uses.withColumn("text", F.when(partial, F.array_join(start, " ")).otherwise(F.col("text")))
    if "n_chars" in names:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(partial, length).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in names])


MIX_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, {KEY_BITS // 4}))::BIGINT AS place
  FROM documents
), corpus AS (
  SELECT sum(size)::BIGINT AS words FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM docs GROUP BY source
), filled AS (
  -- words per weight left if all sources with a lower cap per weight are at their caps; the
  -- least cap that this rate stays below gives the rate for all sources not at their caps
  SELECT s.*, (SELECT arg_min(rate, most) FROM (
      SELECT (any_value(words) - coalesce(sum({MAX_EPOCHS} * c.source_size) FILTER ({MAX_EPOCHS} * c.source_size * k.weight < {MAX_EPOCHS} * k.source_size * c.weight), 0))::DOUBLE
        / sum(c.weight) FILTER ({MAX_EPOCHS} * c.source_size * k.weight >= {MAX_EPOCHS} * k.source_size * c.weight) AS rate,
        {MAX_EPOCHS} * k.source_size::DOUBLE / k.weight AS most
      FROM sources k, sources c, corpus GROUP BY k.source, k.source_size, k.weight)
    WHERE rate <= most) AS rate
  FROM sources s
), goals AS (
  SELECT source, source_size, least({MAX_EPOCHS} * source_size::DOUBLE, coalesce(rate * weight, 1e300)) AS target,
    greatest(1, least({BLOCK_WORDS}, source_size // {SOURCE_BLOCKS}))::BIGINT AS block FROM filled
), shares AS (
  SELECT *, round(target / block * {SLOT_PARTS})::BIGINT AS share FROM goals WHERE target > 0
), bounds AS (
  SELECT *, round(sum(share) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::DOUBLE
    / (SELECT sum(share) FROM shares)::DOUBLE * {POINTS})::BIGINT AS hi FROM shares
), intervals AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM bounds
), slots AS (
  SELECT i, (i * {GOLDEN}::HUGEINT % {POINTS})::BIGINT AS point
  FROM (SELECT unnest(range(((sum(share) + {SLOT_PARTS - 1}) // {SLOT_PARTS})::BIGINT)) AS i FROM shares)
), uses AS (
  SELECT source, r % nb AS b, count(*) AS uses FROM (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS r,
      (source_size + block - 1) // block AS nb
    FROM slots JOIN intervals ON point >= lo AND point < hi)
  WHERE r // nb < {MAX_EPOCHS} GROUP BY ALL
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size, rid
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM docs
), pieces AS (
  SELECT rid, source, b, least(a + size, (b + 1) * block) - greatest(a, b * block) AS n
  FROM (SELECT s.*, block, unnest(range(a // block, (a + size - 1) // block + 1)) AS b
        FROM streams s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source WHERE size > 0)
), took AS (
  SELECT rid, sum(n * coalesce(uses, 0))::BIGINT AS taken
  FROM pieces p LEFT JOIN uses u ON p.source IS NOT DISTINCT FROM u.source AND p.b = u.b GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM docs d LEFT JOIN took USING (rid) JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
"""
