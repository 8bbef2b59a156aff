from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, shard int, spans string, score string"
LONG = "lorem ipsum 12 dolor\n" * 40_000
PROSE = "\n".join(" ".join(f"word{(i * 7 + j * 3) % 97}x{j}" for j in range(9)) for i in range(12))


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None if text is None else len(text), "s", "f", 1, "x", "y")


AWKWARD = [
    row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG, None), row(5, PROSE), row(5, PROSE), row(6, PROSE, None),
    row(None, PROSE), row(None, None, None), row(7, "ß é 中文 🙂   x"), row(8, "one"), row(9, 'password = "abcdefgh123" end'),
    row(10, PROSE.replace("word3x1", "other"), "b"), row(11, "\x00 \x0b null", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
