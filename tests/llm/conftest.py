import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *(T.StructField(n, T.StringType()) for n in ("tag", "fp", "key", "row", "part", "length", "score", "ids", "label one")),
    ]
)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa the of and 42 日本".split()) + rng.choice(["", "", ",", ".", "s"]) for _ in range(n)]


def row(doc_id, text):
    return (doc_id, text, "en", "src0", None if text is None else len(text), *(["x"] * 9))


def edge_rows():
    """Nulls anywhere, empty and blank texts, a very long text, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    long_text = " ".join(words(rng, 40_000))
    other = " ".join(words(rng, 300))
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "one two"), row(None, passage + " tail"), row(None, None),
        row(7, long_text), row(8, long_text + " more"), row(9, other), row(10, other), row(10, other), row(12, other.replace("the", "The", 1)),
        row(13, f"start {passage} end"), row(14, f"{passage}"), row(15, f"x y z {passage} {passage}"), row(16, " ".join(["again"] * 130)),
        row(17, " ".join(["again"] * 90)), row(18, "éa b\x0bc\x0cd\r\ne"), row(20, passage), row(20, other + " same id, other text"), row(21, "😀 " * 60),
    ]
    for i in range(30, 60):
        rows.append(row(i, " ".join(words(rng, rng.randrange(1, 200)))))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in edge_rows()]
