import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, score double, node string, window int, low string, size string"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like an operator's own."""
    long = " ".join(f"word{k % 997} and" for k in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 0.5, "x", 1, "l", "s"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0.5, "x", 1, "l", "s"),
        (4, long, "en", "b", 0.5, "x", 1, "l", "s"),
        (5, "alpha beta gamma delta epsilon zeta", "en", "a", 0.5, "x", 1, "l", "s"),
        (5, "alpha beta gamma delta epsilon zeta", "en", "a", 0.5, "x", 1, "l", "s"),
        (None, "nobody's text, without an id", "de", None, None, None, None, None, None),
        (None, "nobody's text, without an id", "de", None, None, None, None, None, None),
        (8, " \t\n ", "fr", "b", 0.1, "y", 2, "l", "s"),
        (9, "日本語 テスト <|endoftext|> é", "ja", "c", 0.1, "y", 2, "l", "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    from mailshift.llm import bpe

    return Tokenizer.from_file(bpe.default_path())
