import math
import random

import pytest
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs
from quiverine.functions import vector as V
from quiverine.functions.content import content_id, content_id_of


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(values):
    return V.literal(values)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 32, 33, 35])
def test_kernels_at_lengths_around_the_widths_of_unrolled_loops(spark, n):
    xs = [((k * 7) % 11) - 5.0 for k in range(n)]
    ys = [((k * 5) % 13) - 6.0 for k in range(n)]
    x, y = lit(xs), lit(ys)
    row = spark.range(1).select(V.dot(x, y).alias("dot"), V.norm2(x).alias("norm"), V.total(x).alias("sum"), V.smallest(x).alias("min"), V.max_abs(x).alias("most"), V.squared_distance(x, y).alias("d")).first()
    assert row["dot"] == sum(a * b for a, b in zip(xs, ys))
    assert row["norm"] == pytest.approx(math.sqrt(sum(a * a for a in xs)), abs=1e-9)
    assert row["sum"] == sum(xs)
    assert row["min"] == (min(xs) if xs else None)
    assert row["most"] == (max(map(abs, xs)) if xs else None)
    assert row["d"] == sum((a - b) ** 2 for a, b in zip(xs, ys))


@pytest.mark.parametrize(("xs", "norm"), [([0.0] * 7, 0), ([-3e300, 4e300], 5e300), ([5e-310, 0.0, -12e-310], 13e-310), ([2e160] * 9, 6e160), ([-7e-200], 7e-200), ([1e-5, 1e250], 1e250)])
def test_norm_of_extremes(spark, xs, norm):
    assert value(spark, V.norm2(lit(xs))) == pytest.approx(norm, rel=1e-9)


def test_elementwise(spark):
    rng = random.Random(11)
    xs, ys = ([rng.randrange(-64, 64) / 8 for _ in range(21)] for _ in range(2))
    a, b = lit(xs), lit(ys)
    assert value(spark, V.add(a, b)) == [x + y for x, y in zip(xs, ys)]
    assert value(spark, V.subtract(a, b)) == [x - y for x, y in zip(xs, ys)]
    assert value(spark, V.scale(a, -0.25)) == [x * -0.25 for x in xs]
    assert value(spark, V.normalize(lit([3, 4]))) == [0.6, 0.8]
    assert value(spark, V.normalize(lit([0, 0]))) == [0, 0]


def test_lengths_that_differ_raise(spark):
    for f in (V.dot, V.add, V.subtract, V.squared_distance):
        with pytest.raises(Exception, match="vectors of 2 and 1 elements"):
            value(spark, f(lit([1, 2]), lit([1])))


def test_null_vectors_give_null(spark):
    null = F.lit(None).cast("array<double>")
    assert value(spark, V.dot(null, lit([1]))) is None
    assert value(spark, V.norm2(null)) is None


def test_literals_must_be_finite():
    with pytest.raises(InvalidArgs):
        V.literal([1.0, float("nan")])


def test_chunk_and_divide(spark):
    flat = F.array(*(F.lit(float(k)) for k in range(1, 11)))
    assert value(spark, V.chunk(flat, 2)) == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]]
    assert value(spark, V.chunk(F.array().cast("array<double>"), 10)) == []
    with pytest.raises(Exception, match="do not make vectors of 3"):
        value(spark, V.chunk(flat, 3))
    assert value(spark, V.divide(lit(range(6)), 2, 6)) == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(InvalidArgs):
        V.divide(flat, 3, 4)


def test_content_ids(spark):
    for content in (b"", b"abc", bytes(range(256))):
        assert value(spark, content_id(F.lit(content))) == content_id_of(content)
        assert "=" not in content_id_of(content)
