import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanloom.functions import geometry

SQUARE = "0,0 10,0 10,10 0,10"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("points", "said"),
    [("a,b 1,2 3,4", "pair"), ("1,2,3 4,5 6,7", "pair"), ("0,0 1,1", "three points"), ("0,0 1,1 2,2", "no area"), ("0,0 1,nan 2,2", "pair")],
)
def test_malformed_polygons(spark, points, said):
    assert said in one(spark, geometry.polygon_fault(F.lit(points)))


def test_good_polygon_round_trip(spark):
    assert one(spark, geometry.polygon_fault(F.lit(SQUARE))) is None
    assert one(spark, geometry.extract_points(geometry.wrap_points(F.lit(SQUARE)))) == SQUARE
    assert abs(one(spark, geometry.area(geometry.parse_points(F.lit(SQUARE))))) == 100
    with pytest.raises(PySparkException):
        one(spark, geometry.extract_points(F.lit("<svg/>")))


@pytest.mark.parametrize(("x", "y", "wanted"), [(5, 5, True), (0, 5, False), (10, 10, False), (11, 5, False), (5, 0, False), (0.1, 9.9, True)])
def test_inside_is_strict(spark, x, y, wanted):
    assert one(spark, geometry.inside(F.lit(float(x)), F.lit(float(y)), geometry.parse_points(F.lit(SQUARE)))) is wanted


@pytest.mark.parametrize(
    ("box", "wanted"),
    [((10, 10, 12, 12), True), ((11, 0, 12, 1), False), ((-5, 4, 15, 6), True), ((2, 2, 3, 3), True), ((-5, -5, 20, 20), True), ((10.5, -1, 11, 11), False)],
)
def test_boxes_that_touch_overlap(spark, box, wanted):
    got = one(spark, geometry.box_overlap(*[F.lit(float(v)) for v in box], geometry.parse_points(F.lit(SQUARE))))
    assert got is wanted
