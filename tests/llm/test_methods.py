"""The methods themselves, on values that the tables do not hold."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import catalogue, chat, langid, mixture, pages, quality, ranks, simhash, tokens, topk
from wayfare.llm.automaton import DEAD, Automaton
from wayfare.llm.bpe import Vocabulary
from wayfare.llm.components import roots
from wayfare.llm.prefix import totals_before

ODD_TEXT = st.text(alphabet=st.sampled_from("aabbcdeinrstth'' \t\n<|>!;19İΣςſßǅȺ한é😀́\x1c\x85\xa0"), max_size=60)


@lru_cache(maxsize=1)
def vocabulary():
    with open(catalogue.vocabulary(catalogue.WORD_VOCABULARY), encoding="utf-8") as file:
        content = file.read()
    from tokenizers import Tokenizer

    return Vocabulary(content), Tokenizer.from_str(content)


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_bpe_equals_the_library(text):
    mine, library = vocabulary()
    ids = library.encode(text, add_special_tokens=False).ids
    found = mine.encode(text)
    assert np.frombuffer(found, "<u4").tolist() == ids
    assert mine.decode(found) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 70_000, "ab" * 5_000 + "!", "th" * 31, "<|endoftext|>a", ""])
def test_bpe_of_very_long_words(text):
    mine, library = vocabulary()
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == expected


def merged(symbols, merges):
    """Merges applied one after the other, each from the left."""
    for x, y, z in merges:
        out, k = [], 0
        while k < len(symbols):
            if symbols[k : k + 2] == [x, y]:
                out.append(z)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_automaton_accepts_exactly_the_merged_sequences(data):
    base, merges, texts = 2, [], {0: (0,), 1: (1,)}
    for z in range(base, base + data.draw(st.integers(1, 5))):
        x, y = (data.draw(st.integers(0, z - 1)) for _ in range(2))
        if texts[x] + texts[y] in texts.values():
            break
        texts[z] = texts[x] + texts[y]
        merges.append((x, y, z))
    automaton = Automaton(base + len(merges), merges)
    for size in range(1, 8):
        for symbols in itertools.product((0, 1), repeat=size):
            state = 0
            for token in merged(list(symbols), merges):
                state = automaton.step(state, token)
                assert state != DEAD
    # and no other sequence of tokens
    for sequence in itertools.product(range(automaton.tokens), repeat=3):
        state = 0
        for token in sequence:
            state = automaton.step(state, token) if state != DEAD else DEAD
        symbols = [s for token in sequence for s in texts.get(token, ())]
        assert (state != DEAD) == (merged(symbols, merges) == list(sequence))


def test_transitions_kept_are_bounded(monkeypatch):
    mine, library = vocabulary()
    monkeypatch.setattr("wayfare.llm.automaton.MOST_TRANSITIONS", 500)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == expected
    assert len(mine.automaton.table) <= 500


def test_automaton_refuses_merges_out_of_order():
    with pytest.raises(ValueError):
        Automaton(4, [(2, 1, 3), (0, 1, 2)])


@lru_cache(maxsize=1)
def encoder():
    return ranks.ranks(ranks.read(catalogue.vocabulary(catalogue.RANK_FILE)), catalogue.pattern())


@settings(max_examples=200, deadline=None)
@given(ODD_TEXT)
def test_token_spans_cover_the_text(text):
    if not text:
        return
    starts, ends = tokens.spans(encoder(), text)
    raw = b"".join(encoder().bytes[i] for i in encoder().encode(text))
    assert raw == text.encode()
    assert starts[0] == 0 and ends[-1] == len(text) and (starts < ends).all()
    bounds = tokens.lines(text)
    counts, crossing = tokens.counted(starts, ends, bounds[:-1], bounds[1:])
    assert counts.sum() == len(starts) and (crossing <= counts).all()


def test_tokens_outside_all_sections_are_not_counted():
    span = lambda *pairs: tuple(np.array(side) for side in zip(*pairs))
    counts, crossing = tokens.counted(*span((0, 2), (2, 6), (6, 8), (8, 9)), *span((1, 4), (4, 7)))
    # the second token lies half in each section, and counts for the first
    assert counts.tolist() == [2, 1] and crossing.tolist() == [1, 0]


@pytest.mark.parametrize("text", [" " * 600_000, "a" + "\n" * 30_000 + "b", "x" * 300_000, "\t" * 20_000 + " y"])
def test_very_long_runs_are_encoded_whole(text):
    assert encoder().decode(encoder().encode(text)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<\\|im_startend>\nab"), max_size=40))
def test_escapes_are_undone(text):
    hostile = text + chat.START + "<\\|im_end|>" + text
    shown = chat.escape(hostile)
    assert chat.START not in shown and chat.END not in shown
    assert chat.unescape(shown) == hostile
    role = chat.escape_role(hostile)
    assert "\n" not in role and chat.unescape_role(role) == hostile


def test_masks_are_running_sums():
    mask = chat._mask([1, 2, 3, 1, 0, 2], [False, True, False, False, True, True])
    assert mask.tolist() == [0, 1, 1, 0, 0, 0, 0, 1, 1]


def test_long_conversations_come_in_parts(spark, monkeypatch):
    path, pattern = catalogue.vocabulary(catalogue.RANK_FILE), catalogue.pattern()
    monkeypatch.setattr(chat, "PART_TOKENS", 50)
    rows = [(k % 3, k, "assistant" if k % 2 else "user", f"turn {k} " * 9) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = [np.frombuffer(r.body, np.int32) for r in chat.encoded(df, path, pattern).collect()]
    encoded = chat.encoded(df, path, pattern).where("conv_id = 1").orderBy("turn")
    parts = list(chat._joined(encoded.toArrow().to_batches(), encoder()))
    assert sum(p.num_rows for p in parts) >= 5 and sum(map(len, whole)) > 0
    read = list(chat._digested(iter(parts), encoder()))
    assert [b.column("n_turns").to_pylist() for b in read] == [[13]]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_covering_lets_every_near_pair_collide(radius):
    masks = simhash.covering(0, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not mask & differing for mask in masks)
        # and again on the bits that a key leaves free
        outer = rng.choice(masks)
        inside = sum(1 << b for b in rng.sample([b for b in range(64) if not outer >> b & 1], radius))
        assert any(not mask & inside for mask in simhash.covering(outer, radius))


@pytest.mark.parametrize("bucket", [20, 1 << 15])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    rng = random.Random(2)
    prints = set()
    for _ in range(8):
        center = rng.getrandbits(64)
        prints |= {center ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(25)}
    prints = [p - (1 << 64) if p >> 63 else p for p in sorted(p % (1 << 64) for p in prints)]
    group = {p: p for p in prints}
    for _ in range(len(prints)):
        near = [(a, b) for a in prints for b in prints
                if group[b] < group[a] and ((a ^ b) % (1 << 64)).bit_count() <= 4]
        if not near:
            break
        for a, b in near:
            group[a] = min(group[a], group[b])
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in roots(simhash.links(df, 4, bucket), "a", "b").collect()}
    assert {p: found.get(p, p) for p in prints} == group


def test_components_of_long_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in roots(df, "a", "b").collect()}
    assert found == {k: 0 for k in range(1, 201)} | {k: 1000 for k in range(1001, 1400)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_top_k_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-9, 10, (rng.integers(1, 60), rng.integers(1, 12)))
    ids = rng.integers(0, 50, len(rows))
    chosen = rng.integers(0, len(rows), 5)
    k = int(rng.integers(1, 7))
    for q, found, scores in topk.best_of_block(ids, rows, ids[chosen], rows[chosen], k):
        own = ids[chosen][q]
        exact = sorted((-int(r @ rows[chosen][q]), int(i)) for r, i in zip(rows, ids) if i != own)
        assert list(zip((-scores).tolist(), found.tolist())) == exact[:k]


def test_a_proof_stops_the_search_early(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(-1, 2, (3000, 16))
    rows[:20] = rng.integers(-200, 201, (20, 16))
    monkeypatch.setattr(topk, "RESCORED", 0.05)
    index, rescored = topk.Index(rows), []
    monkeypatch.setattr(
        topk.Index, "_rescored", lambda self, *a, f=topk.Index._rescored: rescored.append(1) or f(self, *a)
    )
    own = np.zeros((3000, 4), bool)
    scores = index.top(rows[:4], own, 5)
    assert rescored
    for q in range(4):
        exact = np.sort(rows @ rows[q])[-5:]
        assert np.sort(scores[:, q])[-5:].tolist() == exact.tolist()


def test_values_beyond_64_bits_are_clamped():
    rows = np.array([[2**62, 2**62], [1, 0], [-(2**62), -(2**62)]])
    found = dict((q, s.tolist()) for q, _, s in topk.best_of_block(np.array([1, 2, 3]), rows, np.array([9]), rows[:1], 3))
    assert found[0] == [2**63 - 1, 2**62, -(2**63) + 1]


def test_language_models_are_distributions():
    texts = ["abra cadabra", "barbara aba", "abc"]
    grams: dict[str, int] = {}
    for text in texts:
        points = langid.symbols(text)
        for k in range(langid.ORDER, len(points) + 1):
            gram = tuple(points[k - langid.ORDER : k].tolist())
            grams[gram] = grams.get(gram, 0) + 1
    table = np.array(list(grams), np.uint64), np.array(list(grams.values()))
    model = langid.fitted(["x", "y"], [table, table])
    alphabet = sorted({c for gram in grams for c in gram[-1:]})
    for context in ([97, 98, 114], [32, 32, 32], [99, 99, 99], [120, 120, 97]):
        total = sum(
            2.0 ** model.scores(np.array([*context, c], np.uint64))[0, 0] for c in alphabet
        )
        unknown = 2.0 ** model.scores(np.array([*context, 0x4E00], np.uint64))[0, 0]
        assert total + unknown == pytest.approx(1, abs=1e-5)


def test_whole_texts_are_scored_in_spans(monkeypatch):
    points = langid.symbols("some words of a text " * 50)
    gram = np.array([[32, 115, 111, 109], [115, 111, 109, 101]], np.uint64)
    model = langid.fitted(["x"], [(gram, np.array([2, 1]))])
    whole = model.entropies(points)
    monkeypatch.setattr(langid, "SPAN", 7)
    assert model.entropies(points) == pytest.approx(whole)


def test_short_texts_of_no_language_are_rejected(spark, documents):
    foreign = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."
    strange = {-1: "xqzv kwjp qqxz vbnm zzkx jwqp hgfd xcvq plmk", -2: foreign, -3: foreign[:24], -4: foreign + " " + foreign}
    begins = documents.select((-F.col("doc_id") - 100).alias("doc_id"), F.substring("text", 1, 100).alias("text"))
    short = spark.createDataFrame(list(strange.items()), "doc_id long, text string").union(begins)
    added = short.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id for r in langid.keep(documents.unionByName(added)).collect()}
    assert not kept & strange.keys()
    with_letters = {r.doc_id for r in documents.where("text rlike '[a-zA-Z]'").collect()}
    assert with_letters <= kept
    assert sum(-i - 100 in kept for i in with_letters) >= 0.98 * len(with_letters)


def test_missing_limits_come_from_near_lengths_and_then_from_all_languages():
    rows = [("x", 300, 2 + k / 1000, True) for k in range(60)] + [("y", 20, 3.0, True)] * 9
    measured = pd.DataFrame(rows, columns=["lang", "letters", "entropy", "whole"])
    limits = langid._limits(langid.Model(["x", "y"]), measured)
    assert np.isfinite(limits).all() and (np.diff(limits, axis=0) <= 0).all()
    assert limits[:, 0] == pytest.approx(limits[:, 1])
    assert np.isinf(langid._limits(langid.Model(["x", "y"]), measured[:9])).all()


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), k, rng.randrange(9)) for k in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    bucket = F.floor(F.col("k") / 2)
    found = {r.k: r.before for r in totals_before(df, ["g"], bucket, [F.col("k")], "v", "before").collect()}
    total = {"a": 0, "b": 0}
    for g, k, v in rows:
        assert found[k] == total[g]
        total[g] += v


def test_targets_are_water_filled(spark):
    docs = spark.createDataFrame(
        [(k, "w " * n, s) for k, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 500), ("é", 90), (None, 400)])],
        "doc_id long, text string, source string",
    )
    goals = {r.source: r.target for r in mixture.targets(mixture.measured(docs)).collect()}
    # a and é stop at three times their size; the rest share 1700 by 2, 1 and 2
    assert goals["a"] == 30 and goals["é"] == 270
    assert [goals[s] for s in ("b", "c", None)] == pytest.approx([680, 340, 680])


def test_schedule_keeps_shares_in_every_stretch(spark):
    docs = spark.createDataFrame(
        [(k, "w " * 100, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string"
    )
    corpus = mixture.measured(docs)
    slots = mixture.schedule(mixture.targets(corpus)).orderBy("slot").collect()
    heavy = np.array([r.stream == "sa" for r in slots])
    for start in range(0, len(heavy) - 700, 311):
        assert abs(heavy[start : start + 700].mean() - 5 / 7) < 0.01


def test_small_sources_beside_millions_of_words_come_near_their_targets(spark):
    small = {"c1": 20, "c2": 60, "c3": 130, "c4": 300, "c5": 5000}
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate(small.items())]
    large = spark.range(900).select(
        (F.col("id") + 100).alias("doc_id"),
        F.repeat(F.lit("w "), 10_000).alias("text"),
        F.when(F.col("id") < 560, "a").otherwise("b").alias("source"),
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(large)
    corpus = mixture.measured(docs)
    assert {r.source: r.block_words for r in mixture.targets(corpus).where("block_words > 4").collect()} == {"a": 128, "b": 128}
    goals = {r.source: r.target for r in mixture.targets(corpus).collect()}
    took = {
        r.source: r.n
        for r in mixture.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    }
    assert {s: goals[s] for s in small} == {s: 3 * n for s, n in small.items()}
    reported = {r.source: r.n for r in mixture.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    for s, goal in goals.items():
        assert abs(took.get(s, 0) - goal) <= 0.01 * goal + 6, (s, took.get(s, 0), goal)
        assert abs(reported[s] - goal) <= 0.01 * goal + 6, (s, reported[s], goal)


def test_rules_are_ordered_by_rejection_per_cost(documents):
    steps = quality.plan(documents)
    assert [s.rank for s in steps] == sorted((s.rank for s in steps), reverse=True)
    kept = {r.doc_id for r in quality.keep(documents).collect()}
    backwards, alive = quality.judge(documents, steps=steps[::-1])
    assert {r.doc_id for r in backwards.where(alive).select("doc_id").collect()} == kept


@pytest.mark.parametrize("step", [1, -1])
def test_verdicts_can_be_filtered(spark, documents, step):
    judged, alive = quality.judge(documents, steps=[quality.Step(r, 1.0, 0.5) for r in quality.RULES][::step])
    started = time.monotonic()
    kept = judged.where(alive).count()
    assert kept == judged.select(F.count_if(alive)).first()[0]
    results = quality.quality(documents)
    assert results.where("kept").count() == kept
    assert results.where("NOT kept AND n_words > 20").count() < documents.count()
    assert results.where("base_failed").select("doc_id").count() <= documents.count() - kept
    assert time.monotonic() - started < 60


def test_a_costly_rule_that_rejects_little_comes_last(documents):
    few = quality.Rule("few", ("n_words",), lambda c: c("n_words") < 30)
    for rules in ((quality.REPEATED, few), (few, quality.REPEATED)):
        assert [s.rule.name for s in quality.plan(documents, rules=rules)] == ["few", "repeated_words"]
    # what is computed anyway costs nothing
    steps = quality.plan(documents, report=quality.REPORTED)
    assert all(s.seconds == 0 for s in steps if set(s.rule.metrics) <= set(quality.REPORTED))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_common_subsequence_is_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = pages.common(a, b)
    assert found == sorted(set(found)) and len(found) == best[-1][-1]
    rest = iter(b)
    assert all(a[k] in rest for k in found)


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<p>a<![foo]>b<![ if x]>c</p>", ["abc"]),
        ("<!-->x<!--->y<!-- a > b -->z", ["xyz"]),
        ("<p>a<b c='>'>d</b> < &lt;e&gt;", ["ad < <e>"]),
        ("<p>1</p ><P>2</P></div></x><!doctype html><?pi?></>3", ["1", "2", "3"]),
        ("<script>if (a<b) '</p>'</script>a<title>x<p>y</title><style><p></style>b", ["ab"]),
        ("a<p title='no end", ["a"]),
        ('<article><p class="advert">Buy now</p><p>Text <span hidden>no</span>yes</article>', ["Text yes"]),
        ("<article><p>a <i class=ad>b<i>c</i>d</i>e<li hidden>f<li>g</article>", ["a e", "g"]),
        ("<p style='display: none'>a<p>b<div role=banner><p>c</div><em class=comment>d</em>", ["b", "d"]),
        ("<header><p>a<h1>b</h1></header><article><header><p>c<h2>d</h2></header>e</article>", ["d", "e"]),
    ],
)
def test_markup_is_read_as_browsers_do(html, texts):
    found, best = pages.blocks(html)
    assert [text for level, text in found if level >= best] == texts


@pytest.mark.parametrize(
    "html",
    [
        "<div>a" * 100_000, "<div>a" * 50_000 + "</x></span>" * 50_000, "<a " * 100_000,
        "<a x=\"" * 100_000, "<!--" * 100_000, "<" * 200_000, "&#" * 200_000, "<script>" * 100_000,
        "<header>" * 50_000 + "x", "<p hidden>a" * 50_000, "<span hidden>" * 50_000 + "</i>" * 50_000,
        "<![x" * 100_000, "</" * 100_000, "<article>" * 50_000 + "</article>a" * 50_000,
    ],
)
def test_bad_markup_takes_linear_time(html):
    started = time.monotonic()
    pages.blocks(html)
    assert time.monotonic() - started < 10


def plain_subsequence(a, b):
    """Items of ``a`` on a longest common subsequence with ``b``, by the usual table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@pytest.mark.parametrize("seed", range(2))
def test_differencing_equals_plain_pairing(spark, seed):
    """Unmarked pages of one host: the partner is the neighbour by path, and what is left of a
    page is as long as the page without a longest common subsequence of both."""
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(6)]
    rows = []
    for k in range(30):
        path = "".join(rng.choice("ab") for _ in range(4)) + f"{k:02d}"
        texts = [rng.choice(lines) for _ in range(rng.randint(1, 5))] + [f"own {k}"]
        rng.shuffle(texts)
        rows.append((k, f"http://h.example/{path}", texts))
    html = {k: "".join(f"<p>{t}</p>" for t in texts) for k, _, texts in rows}
    df = spark.createDataFrame([(k, url, html[k]) for k, url, _ in rows], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(df.repartition(4)).collect()}
    ordered = sorted(rows, key=lambda r: r[1])

    def common(a, b):
        return len(commonprefix([a[1], b[1]]))

    for at, row in enumerate(ordered):
        before = ordered[at - 1] if at else None
        after = ordered[at + 1] if at + 1 < len(ordered) else None
        sides = [s for s in (before, after) if s]
        partner = max(sides, key=lambda s: (common(row, s), s is before))
        left = found[row[0]].split("\n\n") if found[row[0]] else []
        assert len(left) == len(row[2]) - plain_subsequence(row[2], partner[2])
        remaining = iter(row[2])
        assert all(text in remaining for text in left)  # in order
        assert f"own {row[0]}" in left


def kneser_ney(texts, alphabet):
    """Probability of a character after a context, by the recursion over plain dictionaries."""
    counts = Counter()
    for text in texts:
        points = [chr(int(p)) for p in langid.symbols(text)]
        for k in range(langid.ORDER, len(points) + 1):
            counts["".join(points[k - langid.ORDER : k])] += 1
    orders = [counts]
    for _ in range(langid.ORDER - 1):  # in how many ways what is shorter is extended to the left
        orders.append(Counter(gram[1:] for gram in orders[-1]))
    orders.reverse()

    def discount(table):
        once, twice = (sum(v == n for v in table.values()) for n in (1, 2))
        return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)

    def probability(context, character):
        if context is None:
            return 1 / (len(alphabet) + 1)
        table = orders[len(context)]
        following = [v for gram, v in table.items() if gram[:-1] == context]
        shorter = probability(context[1:] if context else None, character)
        if not following:
            return shorter
        d, mass = discount(table), sum(following)
        found = table.get(context + character, 0)
        return (found - d if found else 0) / mass + d * len(following) / mass * shorter

    return probability


def test_entropies_equal_a_plain_kneser_ney_recursion():
    texts = {
        "x": ["the cat sat on the mat", "a cat and a hat", "thats that"],
        "y": ["le chat est la", "la natte et le rat", "été à la mer"],
    }
    tables = []
    for lang in texts:
        grams = Counter()
        for text in texts[lang]:
            points = langid.symbols(text)
            for k in range(langid.ORDER, len(points) + 1):
                grams[tuple(points[k - langid.ORDER : k].tolist())] += 1
        ordered = sorted(grams)
        tables.append((np.array(ordered, np.uint64), np.array([grams[g] for g in ordered])))
    model = langid.fitted(list(texts), tables)
    alphabet = {g[-1] for rows, _ in tables for g in rows.tolist()}
    plain = [kneser_ney(texts[lang], alphabet) for lang in texts]
    for text in ("the rat sat", "le mat est été", "zzz qqq", "a", "hat natte xyz à"):
        points = [chr(int(p)) for p in langid.symbols(text)]
        expected = [
            -sum(
                np.log2(p("".join(points[k - langid.ORDER + 1 : k]), points[k]))
                for k in range(langid.ORDER - 1, len(points))
            )
            for p in plain
        ]
        assert model.entropies(langid.symbols(text)) == pytest.approx(expected, rel=1e-5)
        best, score, _, _, _ = langid._judged_points(model, langid.symbols(text))
        assert best == list(texts)[int(np.argmin(expected))]
        assert score == pytest.approx(1 / sum(2.0 ** min(min(expected) - e, 0) for e in expected), rel=1e-4)
