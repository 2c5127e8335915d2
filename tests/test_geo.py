import pytest
from pyspark.sql import functions as F

from marlstone.errors import InvalidValueError
from marlstone.functions import geo
from marlstone.operators.query import point_of


def test_weights_and_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 180.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.distance(*map(F.col, "abcd"))).collect()]
    quarter = 3.141592653589793 / 2 * geo.RADIUS
    assert got == pytest.approx([quarter, 0, 2 * quarter])
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1000.0,), (3000.0,)], "m double").select(geo.weight(F.col("m"))).collect()] == [1, 0.5, 0.25]


def test_stored_precision_and_boxes(spark):
    df = spark.createDataFrame([(-10.0, 90.0), (370.25, 1.0 / 3), (-0.5, 0.0)], "x double, y double")
    got = [tuple(r) for r in df.select(*geo.stored(F.col("x"), F.col("y")), geo.inside(F.col("x"), F.col("y"), -1, -1, 1, 1)).collect()]
    assert got[0] == (0.0, 90.0, False)
    assert got[1][0] == 10.25 and abs(got[1][1] - 1 / 3) < 1 / 57600 and not got[1][2]
    assert got[2] == (359.5, 0.0, True)


def test_points():
    assert point_of([-10, 5]) == (350.0, 5.0) and point_of({"lon": 1, "lat": 2}) == (1.0, 2.0)
    for bad in ({"lon": 1}, [1], [1, 91], "x"):
        with pytest.raises(InvalidValueError):
            point_of(bad)
