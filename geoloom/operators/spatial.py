"""Spatial joins and area derivation.

Polygons are few or many, small or large: each is dealt to the cells, four at most, that its box touches in a grid whose cells are as wide
as the box is; points look into one cell of each of these grids, and an equi-join with an exact test behind it replaces the nested loop.
Points outside of everything go down a tree of the polygons' boxes and keep the branches that can hold the nearest one. Nothing is
broadcast on trust; Spark may still broadcast a side whose size it knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geometry as geo
from geoloom.functions.text import coerce_capacity

INSIDE, EDGE, OUTSIDE = "inside", "on boundary", "outside"


def with_cells(polygons: DataFrame, rings: str, cell: float) -> DataFrame:
    """One row per polygon and grid cell its box touches: cx, cy."""
    b = geo.bounds(F.col(rings))
    at = lambda c: F.floor(c / F.lit(cell))
    return polygons.withColumn("cx", F.explode(F.sequence(at(b["x0"]), at(b["x1"])))).withColumn("cy", F.explode(F.sequence(at(b["y0"]), at(b["y1"]))))


def cell_size(polygons: DataFrame, rings: str = "rings") -> float:
    """Twice the mean box side, so that a polygon touches few cells; 1 without polygons."""
    b = geo.bounds(F.col(rings))
    side = polygons.agg(F.avg(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]))).first()[0]
    return max(2 * side, 1e-9) if side else 1.0


def with_levels(polygons: DataFrame, rings: str) -> DataFrame:
    """One row per polygon and cell its box touches in the grid of its size: level (cells are 2^level wide), cx, cy; four rows at most."""
    b = geo.bounds(F.col(rings))
    side = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(1e-9))
    out = polygons.where(F.size(rings) > 0).withColumn("level", F.ceil(F.log2(side)).cast("int"))
    at = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    return out.withColumn("cx", F.explode(F.sequence(at(b["x0"]), at(b["x1"])))).withColumn("cy", F.explode(F.sequence(at(b["y0"]), at(b["y1"]))))


def containing(points: DataFrame, polygons: DataFrame, point_id: str) -> DataFrame:
    """Each point with each polygon that holds it or on whose boundary it lies.

    points: point_id, x, y; polygons: poly_id, poly_ord, rings and what else is wanted. Adds tier 1 (strictly inside) or 2 (on the
    boundary).
    """
    dealt = with_levels(polygons, "rings")
    levels = [r.level for r in dealt.select("level").distinct().collect()]  # powers of two: some dozens at most
    level = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    # A point on a cell's edge belongs to one cell, and a box that ends there touches this cell too.
    p = points.select(point_id, "x", "y", level).withColumn("cx", at("x")).withColumn("cy", at("y"))
    joined = p.join(dealt, ["level", "cx", "cy"]).drop("level", "cx", "cy")
    edge = geo.on_boundary(F.col("x"), F.col("y"), F.col("rings"))
    tier = F.when(edge, 2).when(geo.inside(F.col("x"), F.col("y"), F.col("rings")), 1)
    return joined.withColumn("tier", tier).where("tier is not null")


def inside_boundary(points: DataFrame, boundary: DataFrame, point_id: str, strict: bool = False) -> DataFrame:
    """Points in any polygon of the boundary; strict leaves out points that only touch it."""
    hits = containing(points, boundary, point_id).where("tier = 1" if strict else "true")
    return points.join(hits.select(point_id).distinct(), point_id, "left_semi")


def assign_neighbourhoods(points: DataFrame, polygons: DataFrame, point_id: str, name: str = "neighbourhood_name") -> DataFrame:
    """Adds neighbourhood and boundary_status: strictly inside first, then on a boundary, then the nearest polygon.

    Ties go to the polygon first in order (poly_ord).
    """
    best = containing(points, polygons, point_id).groupBy(point_id).agg(F.min(F.struct("tier", F.col("poly_ord").alias("ord"), F.col(name).alias("n"))).alias("b"))
    got = points.join(best, point_id, "left")
    left = got.where("b is null").drop("b")
    near = nearest_polygon(left, polygons, point_id, name)
    out = got.where("b is not null").select(*points.columns, F.col("b.n").alias("neighbourhood"), F.when(F.col("b.tier") == 1, INSIDE).otherwise(EDGE).alias("boundary_status"))
    return out.unionByName(near.select(*points.columns, "neighbourhood", F.lit(OUTSIDE).alias("boundary_status")))


#: Levels of the tree of boxes at most; a leaf holds about LEAF polygons where they are spread evenly.
DEPTH, LEAF = 12, 4


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, name: str) -> DataFrame:
    """Points with the nearest polygon, by distance to its boundary, ties to the first in order; adds neighbourhood.

    Polygons are leaves of a tree of cells by the middles of their boxes, and each cell knows the box around all its polygons. A point goes down level
    by level and keeps the cells whose box begins no farther away than the nearest cell's box ends, so it meets few polygons however many there are.
    """
    b = geo.bounds(F.col("rings"))
    boxes = polygons.where(F.size("rings") > 0).select("poly_ord", F.col(name).alias("n"), "rings", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    boxes = boxes.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    s = boxes.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("mx", "my") for k, f in (("low", F.min), ("high", F.max))]).first()
    depth = 0
    while depth < DEPTH and 4**depth * LEAF < s.n:
        depth += 1
    side = max((s.high_mx or 0.0) - (s.low_mx or 0.0), (s.high_my or 0.0) - (s.low_my or 0.0), 1e-9) * (1 + 1e-9)
    at = lambda c, low, k: F.floor((F.col(c) - F.lit(low or 0.0)) / F.lit(side / 2**k)).cast("long")
    leaves = boxes.withColumn("cx", at("mx", s.low_mx, depth)).withColumn("cy", at("my", s.low_my, depth))
    small = leaves.groupBy("cx", "cy").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    at_level = lambda k: small.groupBy(F.shiftright("cx", depth - k).alias("cx"), F.shiftright("cy", depth - k).alias("cy")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    zero = F.lit(0.0)
    gap = lambda p, low, high: F.greatest(F.col(low) - F.col(p), zero, F.col(p) - F.col(high))
    far = lambda p, low, high: F.greatest(F.abs(F.col(p) - F.col(low)), F.abs(F.col(p) - F.col(high)))
    kept = points.select(point_id, F.col("x").alias("px"), F.col("y").alias("py"))
    for k in range(min(depth, 3), depth + 1):
        cells = at_level(k)
        if k <= 3:  # 64 cells at most
            down = kept.join(F.broadcast(cells), F.lit(True))
        else:
            down = kept.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(cells.withColumn("ux", F.shiftright("cx", 1)).withColumn("uy", F.shiftright("cy", 1)), ["ux", "uy"])
        down = down.withColumn("near", F.hypot(gap("px", "x0", "x1"), gap("py", "y0", "y1"))).withColumn("far", F.hypot(far("px", "x0", "x1"), far("py", "y0", "y1")))
        least = F.min("far").over(Window.partitionBy(point_id))
        kept = down.withColumn("least", least).where(F.col("near") <= F.col("least") * (1 + 1e-9) + 1e-9).select(point_id, "px", "py", "cx", "cy")
    met = kept.join(leaves.select("cx", "cy", "poly_ord", "n", "rings"), ["cx", "cy"])
    near = met.groupBy(point_id).agg(F.min(F.struct(geo.distance(F.col("px"), F.col("py"), F.col("rings")).alias("d"), "poly_ord", "n")).alias("b"))
    return points.join(near, point_id, "left").withColumn("neighbourhood", F.col("b.n")).drop("b")


def smallest_container(points: DataFrame, polygons: DataFrame, point_id: str) -> DataFrame:
    """point_id, overlay_m2: area of the smallest polygon that strictly holds the point; ties by poly_id."""
    hits = containing(points.select(point_id, "x", "y"), polygons, point_id).where("tier = 1")
    return hits.groupBy(point_id).agg(F.min(F.struct(geo.area("rings").alias("a"), "poly_id")).alias("b")).select(point_id, F.col("b.a").alias("overlay_m2"))


def add_footprint(features: DataFrame, feature_id: str, rings: str = "rings", capacity: str | None = "capacity", overlay: DataFrame | None = None, square_metres_each: float = 1.5) -> DataFrame:
    """Adds footprint_m2 and area_source: measured polygon, else smallest polygon around the point, else capacity, else nothing."""
    out = features
    if overlay is not None:
        at = smallest_container(features.where(F.col(rings).isNull() & F.col("x").isNotNull()), overlay, feature_id)
        out = out.join(at, feature_id, "left")
    else:
        out = out.withColumn("overlay_m2", F.lit(None).cast("double"))
    derived = coerce_capacity(capacity) * F.lit(square_metres_each) if capacity else F.lit(None).cast("double")
    measured = geo.area(rings)
    return out.withColumn("footprint_m2", F.coalesce(measured, "overlay_m2", derived)).withColumn("area_source", F.when(measured.isNotNull(), "measured").when(F.col("overlay_m2").isNotNull(), "polygon_overlay").when(derived.isNotNull(), "capacity_derived").otherwise("")).drop("overlay_m2")


def boundary_report(points: DataFrame, boundary: DataFrame, point_id: str) -> DataFrame:
    """One row: n, outside, outside_ratio."""
    hit = containing(points, boundary, point_id).select(point_id).distinct().withColumn("hit", F.lit(1))
    return points.join(hit, point_id, "left").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("outside")).withColumn("outside_ratio", F.when(F.col("n") > 0, F.col("outside") / F.col("n")).otherwise(0.0))


def valid_wgs84(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with readable coordinates in range (ends included), as doubles."""
    for c in (lat, lon):
        if c not in rows.columns:
            raise ValueError(f"no column {c}")
    out = rows.withColumn(lat, F.col(lat).cast("string").try_cast("double")).withColumn(lon, F.col(lon).cast("string").try_cast("double"))
    return out.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


# The region of the planner's coordinates (south, north, west, east), and the map's.
PLANNER_BOX, MAP_BOX, AUDIT_BOX = (40.55, 41.65, 27.95, 30.10), (40.5, 42.0, 28.0, 30.0), (40.5, 42.0, 28.0, 30.5)


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> Column:
    return F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])


def coordinate_fault(lat: str, lon: str) -> Column:
    """Why a row's coordinates can't be used, one reason each, or null: missing, range, zero, region."""
    a, b = (F.col(c).cast("string").try_cast("double") for c in (lat, lon))
    return (
        F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), "missing")
        .when(~(a.between(-90, 90) & b.between(-180, 180)), "range")
        .when((F.abs(a) < 1e-9) & (F.abs(b) < 1e-9), "zero")
        .when(~(a.between(*PLANNER_BOX[:2]) & b.between(*PLANNER_BOX[2:])), "region")
    )


def coordinate_audit(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    fault = coordinate_fault(lat, lon)
    return rows.agg(F.count("*").alias("n"), *[F.count_if(fault == x).alias(x) for x in ("missing", "range", "zero", "region")])


def drop_duplicate_features(features: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (element, id) by the given order."""
    rank = F.row_number().over(Window.partitionBy("element", "id").orderBy(*order))
    return features.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def enrich(features: DataFrame, feature_id: str, polygons: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Fixed order: clean geometry, point, area with provenance, neighbourhood with status. Coordinates in metres: x, y, rings."""
    # Generated columns are computed once, whatever is filtered and joined on them later.
    clean = features.select(*[c for c in features.columns if c != "rings"], F.explode(F.array(geo.clean_polygon("rings"))).alias("rings")).select("*", F.explode(F.array(geo.interior_point("rings"))).alias("_p"))
    clean = clean.withColumn("x", F.coalesce(F.col("_p.x"), "x")).withColumn("y", F.coalesce(F.col("_p.y"), "y")).drop("_p").where("x is not null")
    sized = add_footprint(clean, feature_id, overlay=clean.where("rings is not null").select(F.col(feature_id).alias("poly_id"), F.col(feature_id).alias("poly_ord"), "rings"))
    back = geo.to_wgs84("x", "y")
    return assign_neighbourhoods(sized, polygons, feature_id).withColumn(lat, back["lat"]).withColumn(lon, back["lon"])
