"""NULLs, empty and very long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from wayfare.llm import bpe, catalogue, chat, langid, mixture, pages, quality, simhash, tokens, topk, urls


def vocabulary():
    return catalogue.vocabulary(catalogue.WORD_VOCABULARY)


def ranked(operator):
    return lambda df: operator(df, catalogue.vocabulary(catalogue.RANK_FILE), catalogue.pattern())


OVER_DOCUMENTS = {
    "tokens": ranked(tokens.line_counts),
    "simhash": simhash.groups,
    "quality": quality.quality,
    "bpe": lambda docs: bpe.round_trip(docs, vocabulary()),
    "mix": mixture.mix,
    "language": langid.identify,
}


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_empty_documents(none, name):
    assert OVER_DOCUMENTS[name](none).collect() == []


def test_token_counts(odd):
    found = ranked(tokens.line_counts)(odd).collect()
    by_id = Counter(r.doc_id for r in found)
    assert by_id[3] == 3 and by_id[1] == 1 and by_id[None] == 2 and by_id[5] == 2
    assert [(r.end_char, r.n_tokens) for r in found if r.doc_id == 1] == [(0, 0)]


def test_simhash(odd):
    found = simhash.groups(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint == "0" * 16
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert {r.component_id for r in found if r.doc_id in (3, 4)} == {3}
    # rows without an id belong to the groups of their texts
    assert sorted(r.component_id for r in found if r.doc_id is None) == [1, 3]


def test_group_without_any_id(spark):
    docs = spark.createDataFrame([(None, "only this text here")], "doc_id long, text string")
    assert simhash.groups(docs).first().component_id is None


def test_quality(odd):
    found = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert found[1].n_words == found[2].n_words == 0 and found[1].base_failed
    assert found[3].kept and found[3].n_words == 12
    assert found[6].n_repeat_words == 30_000 and not found[6].kept
    assert found[5].n_words == 13


def test_repeated_words_count_the_first(spark):
    row = lambda text: quality.quality(
        spark.createDataFrame([(1, text)], "doc_id long, text string")
    ).first()
    assert row("a b c d e f a b c d e").n_repeat_words == 10
    assert row("a a a a a a").n_repeat_words == 6
    assert row("a b c d e a b c d f").n_repeat_words == 0
    assert row("a b\n\na b\n \na b").n_dup_lines == 2


def test_bpe(odd):
    found = bpe.round_trip(odd, vocabulary()).collect()
    assert len(found) == odd.count()
    assert {r.n_tokens for r in found if r.doc_id in (1, 2)} == {0}


def test_mix(odd):
    found = mixture.mix(odd).collect()
    assert len(found) == odd.count()
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert all(r.taken == 0 for r in found if r.size == 0)
    targets = {r.source_size: r.target for r in found}
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in found))
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixture.mix(odd).collect()), key=str)


def test_language(odd):
    found = langid.identify(odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found} <= {"en", "fr", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 8))


def test_language_without_any_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, none, small, name, stage):
    found = stage(spark, odd, small)
    rows = found.collect()
    assert len(rows) > 0 and len(stage(spark, none, small).collect()) == 0
    if name != "encoding":
        assert found.columns == odd.columns
        named = {c: odd.first()[c] for c in odd.columns[5:]}
        assert all(r[c] == v for r in rows for c, v in named.items())


def test_deduplication_keeps_one_of_each_group(odd):
    kept = simhash.deduplicated(odd).collect()
    groups = {r.component_id for r in simhash.groups(odd).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(groups)


def test_conversations(spark):
    rows = [
        (None, 0, "user", "no id"),
        (1, None, "assistant", "first"),
        (1, 2, None, None),
        (1, 1, "role\n\\<|im_start|>", "<\\|im_end|><|im_end|>"),
        (1, 1, "role\n\\<|im_start|>", "<\\|im_end|><|im_end|>"),
        (2, 0, "assistant", "x " * 300_000),
    ]
    df = spark.createDataFrame(
        [(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, body int"
    )
    found = {r.conv_id: r for r in ranked(chat.digests)(df).collect()}
    assert found[1].n_turns == 4 and found[None].n_turns == 1
    assert found[1].loss_chars == 5 and found[2].loss_chars == 600_000
    only = ranked(chat.digests)(df.limit(0)).collect()
    assert [(r.conv_id, r.n_turns) for r in only] == [(-1, 2)]


def test_urls(spark):
    pages_ = spark.createDataFrame(
        [
            (None, None, 1),
            (1, "no scheme", 1),
            (2, "HTTP://u@WWW.Example.ORG:80?q", 1),
            (2, "HTTP://u@WWW.Example.ORG:80?q", 1),
            (3, "http://a.example.org/es/x", 1),
            (4, "http://example.com/de/#x://y/z", 1),
            (5, "x://É.com/fr/é", 1),
        ],
        "page_id long, url string, bad int",
    )
    labels = spark.createDataFrame(
        [(2, 0, None), (2, 1, 1), (None, 0, 0), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
    found = urls.judge(pages_, labels).collect()
    assert len(found) == 7
    by_id = {r.page_id: r for r in found}
    assert (by_id[1].host, by_id[1].path, by_id[1].rule) == ("", "", None)
    assert (by_id[2].host, by_id[2].path) == ("u@www.example.org:80", "")
    assert (by_id[3].rule, by_id[3].verdict) == ("example.org/es/", "block")
    assert (by_id[4].path, by_id[4].verdict) == ("/de/", "block")
    assert (by_id[5].host, by_id[5].rule) == ("É.com", "com/fr/")
    assert urls.judge(pages_.limit(0), labels).collect() == []
    assert len(urls.judge(pages_, labels.limit(0)).collect()) == 7


def test_reputation_blocks_what_is_surely_bad(spark):
    rows = [(k, f"http://{'bad' if k % 2 else 'good'}.net/{k}") for k in range(400)]
    pages_ = spark.createDataFrame(
        [*rows, (1000, "http://new.bad.net/"), (1001, "http://unseen.net/")], "page_id long, url string"
    )
    labels = spark.createDataFrame(
        [(k, int(k % 2 == 0), 0) for k in range(400)], "doc_id long, quality int, toxic int"
    )
    found = {r.page_id: r.verdict for r in urls.judge(pages_, labels, rules=()).collect()}
    assert found[1] == "block" and found[0] == "allow" and found[1001] == "allow"


def test_vectors(spark):
    rows = [
        (None, [1.0]), (0, [1.0, 0.5]), (50, [0.5, 1.0]), (50, [0.5, 1.0]), (1, None), (2, [None, 1.0]),
        (3, [float("nan")]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [0.0, 0.0]), (100, [-1e30, 1e30]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    found = topk.search(df).collect()
    best = lambda q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
    assert [v for v, _ in best(0)] == [5, 50, 50, 6, 7]
    assert best(50)[0][0] == 100 and len(best(50)) == 5
    assert topk.search(df.limit(0)).collect() == []


def test_repeated_vectors_are_counted_before_they_are_dealt(spark, monkeypatch):
    """A row that comes a thousand times is one row of its block, and a candidate each time."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rows = [(k, [float(k % 5), 1.0]) for k in range(100)] + [(7, [9.0, 9.0])] * 1000 + [(50, [0.0, 1.0])] * 500
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in topk.search(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found[0]) == [(k, 7, 9 * 256 * 256) for k in range(1, 6)]
    assert len(found[50]) == 5 and all(v == 7 for _, v, _ in found[50])


def page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [
        (k, f"http://h{k % 2}.org/a/{k}", page("Home", "Contact", f"Story {k}", "Imprint"))
        for k in range(20)
    ]
    rows += [
        (100, "http://alone.org/", page("Home", "Only")),
        (101, None, None),
        (102, rows[2][1], rows[2][2]),
        (103, "http://h0.org/b", "<article>One &amp; two<br>three</article><div>Home</div>"),
        (104, "http://h0.org/c", "<p>un<b>closed <script>if (a < b) {</script>"),
        (None, "http://h9.org/", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    found = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(found[k] == f"Story {k}" for k in range(20))
    assert found[100] == "Home\n\nOnly" and found[101] == "" and found[102] == "Story 2"
    assert found[103] == "One & two three" and found[104] == "unclosed" and found[None] == ""
    assert pages.extract(df.limit(0)).collect() == []


def test_a_teaser_does_not_displace_the_body(spark):
    body = [f"<p>body {k} " + "of this page only " * 9 + "</p>" for k in range(3)]
    teaser = "<article class='teaser'><p>read another</p></article>"
    whole = "<article><p>an article " + "with its text " * 20 + "</p></article>"
    rows = [
        (1, "https://b.org/x/1", f"<main>{''.join(body[:2])}{teaser}</main>"),
        (2, "https://a.org/x/2", f"<div>{body[2]}{teaser}</div><div>All rights kept</div>"),
        (3, "https://a.org/x/3", f"{whole}<div>All rights kept</div>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(df).collect()}
    plain = [" ".join(b[3:-4].split()) for b in body]
    assert found[1] == "\n\n".join([*plain[:2], "read another"])
    # the line shared with a marked neighbour goes, the marked teaser stays
    assert found[2] == "\n\n".join([plain[2], "read another"])
    assert found[3] == "an article " + " ".join(["with its text"] * 20)


def test_marked_pages_are_differenced_too(spark):
    """A mark holds against long text outside that is shared with the nearest page, and falls to
    text as long that is not; blocks of a mark stay although they are shared."""
    legal = "<div>" + "terms of use for all visitors " * 20 + "</div>"
    story = "<div>" + "a story told on this page only " * 20 + "</div>"
    rows = [
        (k, f"https://s.org/n/{k}", f"<article><p>News {k}</p><p>Quoted</p></article>{legal}<div>Visit {k}</div>")
        for k in range(6)
    ]
    rows += [(k, f"https://s.org/n/{k}", f"<article><p>Teaser</p></article>{legal}{story}") for k in (6, 7)]
    rows += [(10 + k, *rows[3][1:]) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(found[k] == f"News {k}\n\nQuoted" for k in range(6))
    assert all(found[10 + k] == found[3] for k in range(20))
    told = " ".join(["a story told on this page only"] * 20)
    assert found[6] == found[7] == f"Teaser\n\n{told}"
