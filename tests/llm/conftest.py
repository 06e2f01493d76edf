from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return TABLES


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a null id and columns with clashing names."""
    rows = [(0, "alpha beta gamma delta", "en", "a", 1), (1, None, None, None, None),
            (2, "", "en", "a", 2), (3, " \t\n ", "fr", None, 3), (4, "!!! 123", "fr", "b", 4),
            (0, "alpha beta gamma delta", "en", "a", 1), (None, "alpha beta gamma", "en", "b", 5),
            (5, "alpha beta gamma delta", "de", "b", 6), (6, "x " * 30_000, "de", "c", 7)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, fp long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
