from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity, and columns named like the operators' own."""
    prose = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (None, None, None, None, None),
        (None, prose, "en", None, 5),
        (1, "", "en", "a", 0),
        (2, " \t\n\x0b\f\r ", "en", "a", 7),
        (3, prose, "en", "a", 5),
        (3, prose, "en", "a", 5),
        (3, prose, "en", "a", 5),
        (4, prose, None, "b", 5),
        (5, prose.upper() + "\n" + "x" * 100_000, "en", "b", 5),
        (6, " ".join(f"w{k % 5003}" for k in range(30_000)), "en", "é", 5),
        (7, "été 한글 😀 ǅ İ Σ ſ <|endoftext|> <|im_end|> a\u0301", "fr", "é", 5),
        (8, "1234 5678 !!!", "fr", "", 5),
    ]
    names = "words ids row stream place block fp best score n whole rest decoded lines host".split()
    extra = ", ".join(f"{name} int" for name in names)
    marks = tuple(range(len(names)))
    return spark.createDataFrame([(*r, *marks) for r in rows], f"{SCHEMA}, {extra}").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
