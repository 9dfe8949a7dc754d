from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that operators use for their own columns
        StructField("size", StringType()),
        StructField("ids", StringType()),
        StructField("_id", StringType()),
        StructField("score", StringType()),
        StructField("fp", LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-tests-"))


def make_docs(spark, rows):
    """rows: (doc_id, text, source)."""
    full = [
        (i, t, "en", s, None if t is None else len(t), "x", None, "y", None, 7) for i, t, s in rows
    ]
    return spark.createDataFrame(full, DOCS)


def odd_rows(seed: int = 1, n: int = 60):
    """Nulls, empty and blank texts, ties, repeated rows and ids, line breaks,
    other alphabets, one long text, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "An", "ünder", "maß", "λόγος", "x", "don't", "12", "3.5", "?!", "word", "quick", "日本語"]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = make(60), "A shared line of more than twenty characters"
    rows = [
        (1, None, None), (2, "", "a"), (3, " \t\n\r\x0b\x0c ", "a"), (None, "no id here " + passage, "b"),
        (None, None, "b"), (4, "same text " * 9, "hot"), (4, "same text " * 9, "hot"), (5, "same text " * 9, "hot"),
        (6, "  " + line + "\r\n" + line.upper() + "\n\nrest", "hot"), (7, line + "\nown line of the seventh document", "hot"),
        (8, "\n" + line.lower() + "\t\n", "hot"), (9, line, None), (10, "a" * 3000, "b"), (11, " " * 3000 + "x", "b"),
        (12, make(4000), "b"), (13, "'re 'r don't we'll " * 40, "c"), (14, "  " * 30 + "é", "c"),
        (15, "line\n" * 50, "c"), (-3, "negative id", "c"),
    ]
    for i in range(20, 20 + n):
        text = make(rng.randrange(0, 60))
        if i % 3 == 0:
            text += " " + passage + " " + make(rng.randrange(0, 9))
        if i % 5 == 0:
            text += "\n" + line + "\n" + make(5)
        rows.append((i, text, rng.choice(["hot", "hot", "a", "c", "d"])))
        if i % 7 == 0:
            rows.append((i + 1000, text + " x", "hot"))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, odd_rows())


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def pairs(df):
    """(doc_id, text) of a table in memory."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
