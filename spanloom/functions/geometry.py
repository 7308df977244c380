"""Polygons over page coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINTS = r"points=['\"]([^'\"]+)['\"]"


def wrap_points(points: Column) -> Column:
    """The selector's text for a polygon's points."""
    return F.concat(F.lit("<svg:polygon points='"), points, F.lit("' xmlns:svg='http://www.w3.org/2000/svg'/>"))


def points_of(selector: Column) -> Column:
    """The points of the first polygon in a selector; NULL if there are none."""
    return F.nullif(F.regexp_extract(selector, _POINTS, 1), F.lit(""))


def extract_points(selector: Column) -> Column:
    """The points of the first polygon in a selector; an error if there are none."""
    found = points_of(selector)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no polygon points in "), selector)))


def parse_points(points: Column) -> Column:
    """array<struct<x,y>>; a pair that isn't two finite numbers gives a NULL entry."""
    pairs = F.filter(F.split(F.btrim(points), r"\s+"), lambda p: p != "")

    def point(pair: Column) -> Column:
        xy = F.split(pair, ",", -1)
        x, y = F.get(xy, 0).try_cast("double"), F.get(xy, 1).try_cast("double")
        finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        return F.when((F.size(xy) == 2) & finite, F.struct(x.alias("x"), y.alias("y")))

    return F.transform(pairs, point)


def _edges(polygon: Column) -> Column:
    following = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.arrays_zip(polygon.alias("a"), following.alias("b"))


def area(polygon: Column) -> Column:
    """Signed area by the shoelace rule."""
    return F.aggregate(
        _edges(polygon),
        F.lit(0.0),
        lambda total, e: total + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2,
    )


def polygon_fault(points: Column) -> Column:
    """Why a polygon's text can't be used; NULL if it can."""
    polygon = parse_points(points)
    return (
        F.when(points.isNull(), F.lit("polygon has no points"))
        .when(F.exists(polygon, lambda p: p.isNull()), F.lit("each pair of a polygon needs two finite numbers"))
        .when(F.size(polygon) < 3, F.lit("a polygon needs at least three points"))
        .when(area(polygon) == 0, F.lit("the polygon's points enclose no area"))
    )


def on_edge(x: Column, y: Column, polygon: Column) -> Column:
    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        level = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        return level & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(_edges(polygon), touches)


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies strictly within: the boundary is outside, self-crossings count even-odd."""

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < F.try_divide((bx - ax) * (y - ay), by - ay) + ax)

    odd = F.aggregate(_edges(polygon), F.lit(False), lambda s, e: s != F.coalesce(crossed(e), F.lit(False)))
    return odd & ~on_edge(x, y, polygon)


def bounds(polygon: Column) -> Column:
    """struct<x0,y0,x1,y1> of a polygon."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box_overlap(x0: Column, y0: Column, x1: Column, y1: Column, polygon: Column) -> Column:
    """Whether a box and a polygon share a point; touching counts."""

    def side(e: Column) -> Column:
        """Whether an edge meets the box: clip its parameter to the box's slabs."""
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]

        def slab(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
            t, u = F.try_divide(low - a, b - a), F.try_divide(high - a, b - a)
            flat = F.when(a.between(low, high), F.lit(0.0)).otherwise(F.lit(2.0))
            return F.coalesce(F.least(t, u), flat), F.coalesce(F.greatest(t, u), F.lit(1.0))

        (tx, ux), (ty, uy) = slab(ax, bx, x0, x1), slab(ay, by, y0, y1)
        return F.greatest(tx, ty, F.lit(0.0)) <= F.least(ux, uy, F.lit(1.0))

    corner = F.exists(polygon, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    return corner | inside(x0, y0, polygon) | F.exists(_edges(polygon), side)
