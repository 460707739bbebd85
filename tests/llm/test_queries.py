"""Registered queries against SQL, a library or plain loops, on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from wayfare.llm import catalogue

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def rows_of(spark, small, name):
    return catalogue.queries()[name](spark, small).collect()


def test_every_number_is_registered_once():
    names = [n.split("_")[0] for n in catalogue.queries()]
    assert sorted(names) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_its_sql(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == sorted(df.columns)
    got = Counter(tuple(r[c] for c in expected.columns) for r in df.collect())
    assert got == Counter(expected.fetchall())


def test_token_counts_add_up(spark, small, texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(catalogue.RANK_FILE), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    found: dict[int, list] = {}
    for row in rows_of(spark, small, "op1_token_counts"):
        found.setdefault(row.doc_id, []).append(row)
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        sections = sorted(found[doc_id], key=lambda r: r.section)
        assert "".join(text[r.start_char : r.end_char] for r in sections) == text
        # each token, by its characters, to the line with most of them
        raw, at, counts = text.encode(), 0, Counter()
        starts = {r.start_char: r.section for r in sections}
        line = np.array([starts.get(k, -1) for k in range(len(text))])
        line = np.maximum.accumulate(line)
        for token in library.encode_ordinary(text):
            size = len(library.decode_single_token_bytes(token))
            first = len(raw[:at].decode(errors="ignore"))
            last = len(raw[: at + size].decode(errors="ignore"))
            held = Counter(line[first : max(last, first + 1)].tolist())
            counts[min(held, key=lambda s: (-held[s], s))] += 1
            at += size
        assert {r.section: r.n_tokens for r in sections if r.n_tokens} == dict(counts)


def test_html_text_is_the_article(spark, small, duck):
    import html

    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    found = rows_of(spark, small, "op3_html_text")
    assert {r.page_id for r in found} == pages.keys()
    for row in found:
        article = re.search(r"<article>(.*)</article>", pages[row.page_id], re.S).group(1)
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert " ".join(row.text.split()) == plain
        assert row.n_chars == len(row.text)


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least id that each id reaches over pairs of fingerprints within four bits."""
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[b] < group[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a], changed = group[b], True
    return group


def test_simhash_groups_equal_all_pairs(spark, small, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    expected = components(prints)
    found = rows_of(spark, small, "op4_simhash_groups")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{p:016x}", expected[i]) for i, p in prints.items()
    }


def coded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(catalogue.WORD_VOCABULARY))
    library.no_truncation()
    library.no_padding()
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )


def test_bpe_equals_the_library(spark, small, texts):
    expected = dict(zip(texts, coded(texts.values())))
    found = rows_of(spark, small, "op6_bpe_round_trip")
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == expected


def test_language_of_held_out_documents(spark, small, documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    found = rows_of(spark, small, "op9_language_id")
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pipeline_equals_its_stages_in_plain_loops(spark, small, documents, duck):
    rows = {r.doc_id: r for r in documents.collect()}
    kept = {i for i, ok in duck.sql(
        f"SELECT doc_id, kept FROM ({catalogue.oracle_sql()['op5_quality_rules']})"
    ).fetchall() if ok}
    docs = documents
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == documents.columns
        ids = [r.doc_id for r in docs.collect()]
        sizes.append(len(ids))
        if name == "quality_rules":
            assert sorted(ids) == sorted(kept)
        if name == "language_id":
            assert set(ids) <= kept and len(ids) >= 0.95 * len(kept)
            expected = set(components({i: fingerprint(rows[i].text) for i in ids}).values())
        if name == "near_duplicates":
            assert sorted(ids) == sorted(expected)
            words = Counter()
            for i in ids:
                words[rows[i].source] += len(WORD.findall(rows[i].text))
            goals = water_filled(words)
        if name == "source_mix":
            took, copies = Counter(), Counter(ids)
            for r in docs.collect():
                took[r.source] += len(WORD.findall(r.text))
            assert set(copies) <= expected and max(copies.values()) <= 3
            assert all(abs(took[s] - goals[s]) <= 0.02 * goals[s] + 20 for s in goals)
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    mixed = [(r.doc_id, r.text) for r in docs.collect()]
    expected = Counter(zip((i for i, _ in mixed), coded(t for _, t in mixed)))
    assert Counter((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in encoded) == expected
    assert all(len(r.input_ids) == r.n_tokens for r in encoded)


def water_filled(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goals, full, left = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return goals | share
        for s in above:
            goals[s] = 3 * sizes[s]
            left -= goals[s]
            full.add(s)


def test_shuffles_follow_the_bytes_of_the_tables(spark, small, monkeypatch):
    from wayfare import session

    before = session.shuffle_width(spark)
    hundred_tb = 100 * 1024**4
    monkeypatch.setattr(catalogue, "scan_bytes", lambda df: hundred_tb)
    try:
        catalogue.queries()["op2_url_filter"](spark, small)
        assert session.shuffle_width(spark) == 2 * hundred_tb * 2 // session.TASK_BYTES
        monkeypatch.undo()
        catalogue.queries()["op2_url_filter"](spark, small)
        assert session.shuffle_width(spark) == before
    finally:
        session.size_shuffles(spark, 0)


def test_the_pipeline_keeps_no_more_than_its_last_table(spark, small):
    from wayfare.llm import scratch

    since = scratch.mark(spark)
    rows = corpus_pipeline.run(spark, small).count()
    assert rows > 0
    left = scratch._tables[scratch.folder(spark)][since:]
    assert len([name for name in left if "/source_mix-" in name]) == 1
    files, path = scratch.file_system(spark, scratch.folder(spark))
    names = {str(f.getPath().getName()) for f in files.listStatus(path)}
    assert not [n for n in names if n.startswith(("quality_rules-", "language_id-", "near_duplicates-"))]
