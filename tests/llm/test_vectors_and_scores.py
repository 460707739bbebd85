"""Hard negatives, whitening and lattice scores against plain computations."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import catalogue, lattice, russians, whitening
from wayfare.llm.bidiagonal import applied, bidiagonal, dqds, vectors

VECTORS = "vec_id long, embedding array<float>, label int, block int, anchor int, copies int, rank int, x int, n int"
EXTRA = (1, 2, 3, 4, 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTORS)


def embeddings_of(rng, n, width=9, labels=4):
    return [
        (k, [float(np.float32(x)) for x in rng.normal(0, 0.4, width)], int(rng.integers(0, labels)))
        for k in range(n)
    ]


# --- hard negatives ----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 20), st.sampled_from([1, 7, 200, 1 << 20, 1 << 40, 1 << 62]))
def test_table_lookups_are_inner_products(seed, width, largest):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-largest, largest, (5, width), endpoint=True)
    anchors = rng.integers(-largest, largest, (4, width), endpoint=True)
    planes = 1 + max((int(x) if x >= 0 else ~int(x)).bit_length() for x in rows.ravel())
    of = russians.Anchors(anchors, planes)
    (_, tables), = of.tiles()
    found = russians.scored(russians.packed(rows, planes), tables)
    expected = rows.astype(object) @ anchors.astype(object).T
    assert found.tolist() == expected.tolist()


def mined(rows):
    """Plain loops; rows are (id, vector, label), repeated ones count each."""
    rows = [
        (i, [math.floor(256 * x) for x in v], ((l + 1) % 10 if i % 7 == 0 else l))
        for i, v, l in rows
        if i is not None and l is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for a, v, l in {(i, tuple(v), l) for i, v, l in rows if i % 50 == 0}:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, m) for i, w, m in rows)
        positives = [(i, -s) for s, i, m in scored if m == l and i != a][:5]
        for p, score in positives:
            good = [(i, -s) for s, i, m in scored if m != l and 50 * score <= -100 * s <= 95 * score]
            for rank, (i, s) in enumerate(good[:3], 1):
                out[a, p, rank, i, score, s] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_equal_plain_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(russians, "BLOCK_ROWS", 60)
    monkeypatch.setattr(russians, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(russians, "TILE_ANCHORS", 1)
    rng = np.random.default_rng(seed)
    rows = embeddings_of(rng, 160)
    rows += [(1000 + k, rows[3][1], k % 3) for k in range(40)]  # ties
    rows += [rows[5]] * 4 + [rows[50]] * 3  # repeated rows, an anchor among them
    rows += [
        (None, rows[0][1], 1), (2001, None, 1), (2002, rows[0][1], None), (2003, [], 2),
        (2004, [1.0, None], 1), (2005, [math.nan] * 9, 1), (2050, [math.inf] * 9, 1),
        (2100, [0.0] * 9, 1), (2150, rows[1][1][:4], rows[1][2]),
    ]
    df = frame(spark, rows).repartition(3)
    found = Counter(
        tuple(r) for r in russians.negatives(df)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    )
    assert found == mined(rows)
    assert found


def test_hard_negatives_of_huge_values_and_empty_tables(spark):
    huge = [(k, [3e38 * (-1) ** k, 1.0], k % 2) for k in range(51)]
    assert isinstance(russians.negatives(frame(spark, huge)).collect(), list)
    assert russians.negatives(frame(spark, huge).limit(0)).collect() == []
    assert russians.negatives(frame(spark, [(0, [1.0], 1), (50, [1.0], 2)])).collect() == []


# --- whitening ---------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 24), st.integers(0, 24))
def test_singular_values_and_vectors(seed, n, rank):
    rng = np.random.default_rng(seed)
    rank = min(rank, n)
    a = rng.integers(-3, 4, (n, rank)).astype(float) @ rng.integers(-3, 4, (rank, n))
    diagonal, above, right = bidiagonal(a)
    values = dqds(diagonal, above)
    expected = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(expected[0], 1.0)
    assert np.abs(values - expected).max() <= 1e-12 * top
    kept = values[values > 1e-12 * top][:8]
    axes = np.array([applied(right, v) for v in vectors(diagonal, above, kept)]).reshape(-1, n)
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max(initial=0) < 1e-10
    assert np.abs(a.T @ a @ axes.T - axes.T * kept).max(initial=0) < 1e-9 * top


def test_equal_singular_values_get_orthonormal_vectors():
    rng = np.random.default_rng(0)
    left, right = (np.linalg.qr(rng.normal(size=(20, 20)))[0] for _ in range(2))
    for spread in (0.0, 1e-13, 1e-9, 1e-5):
        a = left @ np.diag([5 + spread * k for k in range(9)] + [1.0] * 11) @ right
        diagonal, above, reflectors = bidiagonal(a)
        values = dqds(diagonal, above)[:8]
        axes = np.array([applied(reflectors, v) for v in vectors(diagonal, above, values)])
        assert np.abs(axes @ axes.T - np.eye(8)).max() < 1e-12
        assert np.abs(a.T @ a @ axes.T - axes.T * values).max() < 1e-12 * 25


def whitened(rows, width):
    x = np.array([
        [math.floor(1024 * c) + 100_000 for c in (list(v) + [0.0] * width)[:width]]
        for _, v, _ in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ], object)
    n = len(x)
    deviations = n * x - x.sum(axis=0)
    centred = (deviations / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, (deviations**2).sum(axis=1), centred, values[::-1], axes[:, ::-1]


def test_whitening_equals_an_eigenvalue_solver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    rows = embeddings_of(rng, 200, width=12)
    rows = [(i, [x * (1 + 3 * k) for k, x in enumerate(v)], l) for i, v, l in rows]
    rows += [rows[7]] * 3 + [(500, rows[1][1][:5], None), (501, None, 1), (502, [1.0, math.nan], 1)]
    good = rows[:204]
    df = frame(spark, rows).repartition(9)
    found = whitening.whiten(df).collect()
    n, deviations, centred, values, axes = whitened(rows, 12)
    assert n == 204 and len(found) == n * 8 and {r.n for r in found} == {n}
    expected = dict(zip((i for i, _, _ in good), deviations))
    assert all(r.deviation == expected[r.vec_id] for r in found)
    shares = {r.component: r.explained for r in found}
    assert np.allclose([shares[k] for k in range(1, 9)], values[:8] / values.sum(), rtol=1e-10)
    projected = centred @ axes[:, :8] / np.sqrt(values[:8])
    place = {i: k for k, (i, _, _) in enumerate(good)}
    signs = {}
    for r in found:
        want = projected[place[r.vec_id], r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want * r.whitened) or 1)
        assert abs(r.whitened - sign * want) < 1e-8
    assert {r.identity_error for r in found}.pop() < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)]).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)] * 5)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [], 1), (2, None, 1)])).collect() == []
    # two rows vary in one direction only
    found = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (None, [2.0, 2.0], 1)])).collect()
    assert sorted((r.component, round(abs(r.whitened), 9), r.explained) for r in found) == [(1, 1.0, 1.0)] * 2
    assert len(whitening.whiten(frame(spark, [(k, [1e38 * (k % 3), 1.0], 1) for k in range(9)])).collect()) == 9


# --- lattice scores ----------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOY = [(b" a", 0), (b"a", 1), (b"ab", 2), (b" ab", 3), (b"b", 4), (b"ba", 5), (b"bab", 6), (b" ", 7)]
PROSE = st.text(alphabet="ab", max_size=7)


def total(spelling, weights):
    """Sum over all sequences of pieces, by trying every cut."""
    if not spelling:
        return 1.0
    return sum(
        weights.get(spelling[:k], 0.0) * total(spelling[k:], weights) for k in range(1, len(spelling) + 1)
    )


@settings(max_examples=100, deadline=None)
@given(st.lists(PROSE, min_size=1, max_size=6))
def test_marginals_sum_over_all_segmentations(words):
    words = [w.encode() for w in words]
    scores = np.log(np.arange(1, len(TOY) + 1) / 50)
    weights = {piece: math.exp(s) for (piece, _), s in zip(TOY, scores)}
    lattices = lattice.Lattices(lattice.Trie([p for p, _ in TOY]), words)
    found = lattices.marginals(scores)
    assert np.allclose(np.exp(found), [total(b" " + w, weights) for w in words], rtol=1e-12)
    # what is expected of a piece is how the log of the whole answers to its score
    counts = np.arange(1.0, len(words) + 1)
    expected = lattices.expected(scores, counts)
    for piece in range(len(TOY)):
        step = np.zeros(len(TOY))
        step[piece] = 1e-6
        slope = (lattices.marginals(scores + step) - lattices.marginals(scores - step)) @ counts / 2e-6
        assert abs(slope - expected[piece]) < 1e-6 * max(1, slope)


def test_pieces_never_reach_over_a_mark():
    vocabulary = lattice.pieces(catalogue.vocabulary(catalogue.PIECE_MODEL))
    assert all(b" " not in spelling[1:] for spelling, _ in vocabulary)
    assert {bytes([k]) for k in range(256)} <= {spelling for spelling, _ in vocabulary}
    assert len({spelling for spelling, _ in vocabulary}) == len(vocabulary) > 20_000


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def fitted(texts, rounds):
    """Model of training texts by plain recursions over Python dictionaries."""
    vocabulary = lattice.pieces(catalogue.vocabulary(catalogue.PIECE_MODEL))
    prior = dict(zip((s for s, _ in vocabulary), lattice.prior(vocabulary)))
    words = Counter(w for t in texts for w in words_of(t))

    def normalised(expected):
        weights = {s: expected.get(s, 0.0) + lattice.PRIOR_TOKENS * p for s, p in prior.items()}
        whole = sum(weights.values()) + len(texts if expected else []) + 1
        ends = len(texts) if expected else 0
        return {s: w / whole for s, w in weights.items()}, (ends + 1) / whole

    longest = max(map(len, prior))

    def ways(word, scores):
        size = len(word)
        arcs = [
            (i, j, word[i:j]) for i in range(size) for j in range(i + 1, min(size, i + longest) + 1)
            if word[i:j] in scores
        ]
        ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
        for i, j, s in sorted(arcs, key=lambda a: a[1]):
            ahead[j] += ahead[i] * scores[s]
        for i, j, s in sorted(arcs, key=lambda a: -a[0]):
            behind[i] += scores[s] * behind[j]
        return arcs, ahead, behind

    scores, end = normalised({})
    for _ in range(rounds):
        expected = Counter()
        for word, times in words.items():
            arcs, ahead, behind = ways(b" " + word.encode(), scores)
            for i, j, s in arcs:
                expected[s] += times * ahead[i] * scores[s] * behind[j] / ahead[-1]
        scores, end = normalised(expected)
    return lambda word: math.log10(ways(b" " + word.encode(), scores)[1][-1]), math.log10(end)


def plain_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    known = Counter(w for t in train for w in words_of(t))
    n = sum(known.values()) + len(train)
    v = len(known) + bool(train)
    marginal, end = fitted(train, lattice.ROUNDS)
    for i, text in rows:
        words = words_of(text)
        counts = [known[w] for w in words] + [len(train)]
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in counts)
        score = end + sum(marginal(w) for w in words)
        yield i, held(i), len(counts), sum(c > 0 for c in counts), n, base, score


def compared(found, rows):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])

    expected = sorted(plain_scores(rows), key=key)
    got = sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found),
        key=key,
    )
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


@pytest.mark.parametrize("share", [2, 100])
def test_scores_equal_plain_recursions(spark, documents, monkeypatch, share):
    monkeypatch.setattr(lattice, "FREQUENT_SHARE", share)
    monkeypatch.setattr(lattice, "BATCH_BYTES", 300)
    docs = documents.where("length(text) < 1500").orderBy("doc_id").limit(40).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = catalogue.vocabulary(catalogue.PIECE_MODEL)
    compared(lattice.score(docs.repartition(3), path).collect(), rows)


def test_scores_of_odd_rows(spark, odd, none):
    path = catalogue.vocabulary(catalogue.PIECE_MODEL)
    found = lattice.score(odd.withColumn("word", F.lit("x")), path).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd.collect())
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in found)
    empty = {r.doc_id: r for r in found}[2]
    assert (empty.n_tokens, empty.n_known) == (1, 1)
    same = {(r.score, r.base_score) for r in found if r.doc_id == 3}
    assert len({tuple(round(x, 6) for x in pair) for pair in same}) == 1
    assert lattice.score(none, path).collect() == []
    short = odd.where("coalesce(length(text), 0) < 200")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    compared(lattice.score(short, path).collect(), rows)
    # all held out: the prior alone
    only = short.where(lattice.fold() == lattice.HELD_OUT)
    assert {r.train_tokens for r in lattice.score(only, path).collect()} <= {0}


def test_all_texts_together_have_at_most_all_probability():
    vocabulary = [(b" ", 0), (b"a", 1), (b" a", 2), (b"aa", 3), (b"b", 4), (b"ab", 5), (b" b", 6)]
    model = lattice.Model(vocabulary)
    model.set(np.array([1.0, 5, 3, 2, 1, 4, 1]), 30)
    words = [b"".join(w) for k in range(7) for w in itertools.product((b"a", b"b"), repeat=k)]
    found = np.exp(lattice.Lattices(lattice.Trie(model.spellings), words).marginals(model.scores))
    one_word = found.sum()
    texts = sum(one_word**k for k in range(30)) * math.exp(model.end)
    assert 0.1 < texts <= 1
