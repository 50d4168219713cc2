"""Registered queries of polygon union, repair and ring assembly over shapes derived from the tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import geometry as geo
from geoloom.operators import overlay
from geoloom.plans.fixtures import ensure_checkpoints, oracle, view

_BOX = "SELECT x AS x0, y AS y0, x + 200 + (area_idx * 37) % 900 AS x1, y + 200 + (area_idx * 53) % 700 AS y1 FROM f_areas"
_COVER = f"SELECT a, b, c, d, EXISTS (SELECT 1 FROM ({_BOX}) WHERE x0 <= a AND x1 >= b AND y0 <= c AND y1 >= d) AS hit FROM (SELECT v AS a, lead(v) OVER (ORDER BY v) AS b FROM (SELECT x0 AS v FROM ({_BOX}) UNION SELECT x1 FROM ({_BOX}))) CROSS JOIN (SELECT v AS c, lead(v) OVER (ORDER BY v) AS d FROM (SELECT y0 AS v FROM ({_BOX}) UNION SELECT y1 FROM ({_BOX}))) WHERE b IS NOT NULL AND d IS NOT NULL"


def _boxes(spark, d) -> DataFrame:
    x1, y1 = F.col("x") + 200 + (F.col("area_idx") * 37) % 900, F.col("y") + 200 + (F.col("area_idx") * 53) % 700
    return view(spark, d, "f_areas").select("area_idx", geo.box(F.col("x"), F.col("y"), x1, y1).alias("rings"))


@query("union_area", oracle(f"SELECT CAST(round(sum((b - a) * (d - c))) AS BIGINT) AS area FROM ({_COVER}) WHERE hit"))
def union_area(spark, d):
    """Area of all boxes around the areas together, overlaps once."""
    return overlay.boundary_figures(overlay.union_boundary(_boxes(spark, d))).select(F.round("area").cast("long").alias("area"))


@query("union_parts", oracle(f"SELECT CAST(round(sum((b - a) * (d - c))) AS BIGINT) AS area FROM ({_COVER}) WHERE hit"))
def union_parts(spark, d):
    """The same area, from the chained rings: outer rings count, holes are taken off."""
    ensure_checkpoints(spark)
    rings = overlay.union_rings(overlay.union_boundary(_boxes(spark, d))).select(F.explode("rings").alias("r"))
    turns = F.aggregate(F.sequence(F.lit(0), F.size("r") - 2), F.lit(0.0), lambda s, k: s + F.get("r", k)["x"] * F.get("r", k + 1)["y"] - F.get("r", k + 1)["x"] * F.get("r", k)["y"]) / 2
    return rings.agg(F.round(F.sum(turns)).cast("long").alias("area"))


def _ring(*corners: tuple[Column | float, Column | float]) -> Column:
    lit = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in corners])


_SIDE = "SELECT building_idx, CAST(2 * (10 + building_idx % 40) AS DOUBLE) AS s FROM f_buildings"


@query("repaired_shapes", oracle(f"SELECT building_idx, CAST(CASE building_idx % 4 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS parts, CAST(CASE building_idx % 4 WHEN 0 THEN s * s / 2 WHEN 1 THEN s * s WHEN 2 THEN s * s * 3 / 4 ELSE s * s END AS BIGINT) AS area FROM ({_SIDE})"))
def repaired_shapes(spark, d):
    """Bow ties, spikes, holes that run the same way as their outer ring, and sound squares, at every building."""
    b = view(spark, d, "f_buildings").select("building_idx", "x", "y", (F.lit(2.0) * (10 + F.col("building_idx") % 40)).alias("s"))
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    bow, square = _ring((x, y), (x + s, y + s), (x + s, y), (x, y + s)), _ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    spike = _ring((x, y), (x + s, y), (x + s, y + s), (x + s, y + 2 * s), (x + s, y + s), (x, y + s))
    hole = _ring((x + s / 4, y + s / 4), (x + s * 3 / 4, y + s / 4), (x + s * 3 / 4, y + s * 3 / 4), (x + s / 4, y + s * 3 / 4))
    kind = F.col("building_idx") % 4
    shapes = b.withColumn("rings", F.when(kind == 0, F.array(bow)).when(kind == 1, F.array(spike)).when(kind == 2, F.array(square, hole)).otherwise(F.array(square)))
    return overlay.repair(shapes, "building_idx").groupBy("building_idx").agg(F.count("*").alias("parts"), F.round(F.sum(geo.area("rings"))).cast("long").alias("area"))


@query("assembled_areas", oracle("SELECT area_idx, CAST(CASE WHEN area_idx % 2 = 0 THEN s * s * 3 / 4 ELSE s * s END AS BIGINT) AS area, CAST(CASE WHEN area_idx % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_rings, CAST(CASE WHEN area_idx % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS open_ways FROM (SELECT area_idx, CAST(4 * (10 + area_idx % 40) AS DOUBLE) AS s FROM f_areas)"))
def assembled_areas(spark, d):
    """Each area's square as three ways in changing order and direction, every second with a hole, every third with a way that leads nowhere."""
    a = view(spark, d, "f_areas").select("area_idx", "x", "y", (F.lit(4.0) * (10 + F.col("area_idx") % 40)).alias("s"))
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    turned = lambda way: F.when(F.col("area_idx") % 5 < 2, F.reverse(way)).otherwise(way)
    ways = [turned(_ring((x + s, y + s), (x, y + s))), _ring((x, y), (x + s, y), (x + s, y + s)), turned(_ring((x, y + s), (x, y)))]
    hole = _ring((x + s / 4, y + s / 4), (x + s * 3 / 4, y + s / 4), (x + s * 3 / 4, y + s * 3 / 4), (x + s / 4, y + s * 3 / 4), (x + s / 4, y + s / 4))
    loose = _ring((x + s, y + s), (x + 2 * s, y + 2 * s))
    none = F.lit(None).cast(hole_type := f"{geo.RING}")
    rows = a.select("area_idx", F.explode(F.array_compact(F.array(*[w.cast(hole_type) for w in ways], F.when(F.col("area_idx") % 2 == 0, hole.cast(hole_type)).otherwise(none), F.when(F.col("area_idx") % 3 == 0, loose.cast(hole_type)).otherwise(none)))).alias("points"))
    got = overlay.assemble(rows, "area_idx")
    return got.select("area_idx", F.round(geo.area("rings")).cast("long").alias("area"), F.size("rings").cast("long").alias("n_rings"), F.col("open_ways").cast("long").alias("open_ways"))
