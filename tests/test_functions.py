"""Vector and scalar functions on golden values."""

import math

import pytest
from pyspark.sql import functions as F

from vecloom.functions import scalars as X
from vecloom.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [3.0, -1.0, 4.0, -1.5, 5.0, -9.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, v array<float>, z array<float>")


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


def golden_cases():
    return [
        (V.dot("a", "b"), 32.0), (V.l2_squared("a", "b"), 27.0), (V.l2("a", "b"), math.sqrt(27)), (V.cosine_similarity("a", "b"), 0.9746318461970762), (V.l1("a", "b"), 9.0),
        (V.ip_distance("a", "b"), -32.0), (V.hamming("a", "b"), 3.0), (V.fold("v"), 0.5), (V.mean("v"), 0.5 / 6), (V.norm_l1("v"), 23.5), (F.array_max("v"), 5.0), (F.array_min("v"), -9.0),
        (V.argmax("v"), 4), (V.argmin("v"), 5), (V.cosine_distance("a", "z"), 1.0), (V.cosine_similarity("z", "z"), 0.0), (V.normalize("z"), None), (V.normalize_l1("z"), None),
        (V.normalize_or_keep("z"), [0.0, 0.0, 0.0]), (V.div("a", 0.0), [0.0, 0.0, 0.0]), (V.scale("a", 2.0), [2.0, 4.0, 6.0]), (V.add("a", "b"), [5.0, 7.0, 9.0]), (V.sub("b", "a"), [3.0, 3.0, 3.0]),
        (V.is_valid("a"), True), (V.is_valid(F.array().cast("array<float>")), False), (V.equal("a", "a"), True), (V.equal("a", "v"), False), (V.cross("a", "b"), [-3.0, 6.0, -3.0]),
        (V.constant(1.5, 2), [1.5, 1.5]), (V.int8_quantize("a", 1.0, 3.0), [-128, 0, 127]), (V.int8_dot(F.array(F.lit(2), F.lit(-3)), F.array(F.lit(5), F.lit(7))), -11),
    ]


def test_golden(one):
    for k, (column, expected) in enumerate(golden_cases()):
        got = value(one, column)
        assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected, k


def test_variance_is_of_the_population(one):
    x = [3, -1, 4, -1.5, 5, -9]
    m = sum(x) / 6
    assert value(one, V.variance("v")) == pytest.approx(sum((e - m) ** 2 for e in x) / 6)
    assert value(one, V.stddev("v")) == pytest.approx(math.sqrt(sum((e - m) ** 2 for e in x) / 6))


def test_invalid_elements(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, None],), ([1.0, 2.0],)], "v array<float>")
    assert [r["x"] for r in df.select(V.is_valid("v").alias("x")).collect()] == [False, False, False, True]


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0],), ([0.5] * 4,)], "v array<float>")
    rows = df.select(V.normalize("v").alias("n"), V.is_normalized("v", 1e-4).alias("u"), V.norm_l1(V.normalize_l1("v")).alias("l")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8, 0, 0])
    assert [r["u"] for r in rows] == [False, True] and all(r["l"] == pytest.approx(1) for r in rows)


def test_int8_round_trip(one):
    codes = V.int8_quantize("v", -9.0, 5.0)
    assert value(one, V.int8_dequantize(codes, -9.0, 5.0)) == pytest.approx([3, -1, 4, -1.5, 5, -9], abs=14 / 255)


def test_random_is_repeatable(spark):
    df = spark.range(50)
    a = df.select(V.random_uniform(F.col("id"), 20).alias("u"), V.random_gaussian(F.col("id"), 20).alias("g")).collect()
    assert a == df.repartition(7).select(V.random_uniform(F.col("id"), 20).alias("u"), V.random_gaussian(F.col("id"), 20).alias("g"), "id").orderBy("id").drop("id").collect()
    u, g = [x for r in a for x in r["u"]], [x for r in a for x in r["g"]]
    assert all(-1 <= x < 1 for x in u) and abs(sum(u) / len(u)) < 0.06
    assert abs(sum(g) / len(g)) < 0.12 and abs(sum(x * x for x in g) / len(g) - 1) < 0.2


def scalars_cases():
    return [
        (X.split_chars(F.lit("a,b;;c;"), ",;"), ["a", "b", "", "c"]), (X.split_chars(F.lit("a,b,c"), ",", 2), ["a", "b"]), (X.find(F.lit("hello"), "l"), 2), (X.find(F.lit("hello"), "x"), -1), (X.find(F.lit("hello"), ""), 0),
        (X.find_last(F.lit("hello"), "l"), 3), (X.find_last(F.lit("hello"), "x"), -1), (X.compare(F.lit("a"), F.lit("b")), -1), (X.compare(F.lit("ab"), F.lit("ac"), 1), 0), (X.compare(F.lit("AB"), F.lit("ab"), ignore_case=True), 0),
        (X.parse_integer(F.lit(" 42abc")), 42), (X.parse_integer(F.lit("x")), 0), (X.parse_double(F.lit("-1.5e2kg")), -150.0), (X.format_truncated(F.lit(1.999), 2), "1.99"), (X.format_truncated(F.lit(-1.999), 1), "-1.9"),
        (X.clamp(F.lit(7), 1, 5), 5), (X.guarded_sqrt(F.lit(-1.0)), 0.0), (X.guarded_log(F.lit(0.0)), -1e300), (X.guarded_log1p(F.lit(-2.0)), -1e300), (X.guarded_expm1(F.lit(60.0)), 1e20), (X.equals_ignore_case(F.lit("Ab"), F.lit("aB")), True),
    ]


def test_scalars(one):
    for k, (column, expected) in enumerate(scalars_cases()):
        assert value(one, column) == expected, k


def test_murmur3_known_values():
    assert X.murmur3_32(b"") == 0
    assert X.murmur3_32(b"", 1) == 0x514E28B7
    assert X.murmur3_32(b"test") == 0xBA6BD213
    assert X.murmur3_32(b"Hello, world!") == 0xC0363E43
