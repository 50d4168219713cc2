"""The tables of the two report workbooks, as DataFrames by sheet name: `sources.workbook.write_workbook` stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import analytics, population
from geoloom.plans.pipelines import Placement


def extraction_tables(rows: DataFrame, categories: list[str], category: str = "category", summary: str = "Summary", pivot: str = "Neighborhood Pivot", checks: str = "Data Quality") -> dict[str, DataFrame]:
    """Summary with a total, neighbourhoods by categories with a total row, one sheet a category, and data quality.

    rows: category, neighbourhood, latitude, footprint_m2, confidence and what else the category sheets should show.
    """
    out = {summary: analytics.category_summary(rows), pivot: analytics.neighbourhood_pivot(rows, categories, total_row=True)}
    for c in categories:
        out[c] = rows.where(F.col(category) == c).drop(category)
    out[checks] = analytics.quality(rows)
    return out


def pairs(spark, figures: dict[str, object]) -> DataFrame:
    """(parameter, value) in the given order, values as text."""
    rows = [(k, None if v is None else f"{v:.2f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)) for k, v in figures.items()]
    return spark.createDataFrame(rows, "parameter string, value string")


def placement_figures(placed: Placement) -> DataFrame:
    """One row: how many are assigned and not, and their times by buildings and by people."""
    rows, m, w = placed.assigned, F.col("minutes").cast("double"), F.col("weight")
    zero = F.lit(0.0)
    out = [F.count("*").alias("assigned"), F.coalesce(F.sum(w), zero).alias("people"), F.coalesce(F.avg(m), zero).alias("mean_minutes"), F.coalesce(F.max(m), zero).alias("max_minutes"), F.coalesce(F.percentile(m, 0.95), zero).alias("p95_minutes"), F.count_if(m > 15).alias("far"), F.count_if(m <= 5).alias("excellent"), F.coalesce(F.sum(w * m) / F.sum(w), zero).alias("mean_minutes_people"), F.coalesce(F.sum(w * m), zero).alias("weighted_minutes")]
    for x in (5, 10, 30):
        out += [F.coalesce(F.avg((m <= x).cast("double")) * 100, zero).alias(f"within_{x}_pct"), F.coalesce(F.sum(F.when(m <= x, w).otherwise(zero)) / F.sum(w) * 100, zero).alias(f"within_{x}_people_pct")]
    return rows.agg(*out)


def placement_tables(placed: Placement, areas: DataFrame, objective: str = "min_sum", use_capacity: bool = False, limit: float | None = None, other: Placement | None = None) -> dict[str, DataFrame]:
    """Nine sheets of a placement, and a tenth against another one (with or without capacities) if that is given.

    areas: area_idx, name, x, y, capacity, area_m2.
    """
    spark, s = areas.sparkSession, placed.solution
    figures = placement_figures(placed).first().asDict()
    lost = placed.unreachable
    people = analytics.weighted_percentile(placed.assigned, "minutes", "weight", 0.95).first()
    summary = {"objective": objective, "limit in minutes": limit, "capacities": use_capacity, "open areas": len(s.open_areas), "method": s.status, "rounds": s.iterations, "converged": s.converged, "gap": s.gap, **figures, "p95_minutes_people": float(people[0]) if people and people[0] is not None else None, "unreachable": lost.count(), "cost": float(s.cost)}
    opened = spark.createDataFrame([(int(x),) for x in s.open_areas], "area_idx int")
    roster = areas.join(opened, "area_idx", "left_semi").select("area_idx", "name", "x", "y", "capacity", "area_m2").orderBy("area_idx")
    method = {"travel times": "shortest ways from every building to every area in reach", "cost": {"min_sum": "weighted minutes in all", "min_max": "the longest way", "min_p95": "95th percentile of weighted minutes"}[objective], "search": "all sets of areas where few, else a greedy start and swaps, with a Lagrangian bound", "assignment": "nearest open area with room" if use_capacity else "nearest open area"}
    guide = {"band": "Excellent up to 5 minutes, Good to 10, Acceptable to 15, Far to 30, Very far beyond", "alt_1_area": "nearest open area besides the assigned one, and so on to the third", "reason": "1: no area in reach, 2: those in reach are full"}
    readable = [c for c in ("building_idx", "neighbourhood", "weight", "area_name", "minutes", "band") if c in placed.assigned.columns]
    full = placed.assigned.orderBy("building_idx")
    out = {
        "1. Summary": pairs(spark, summary),
        "2. Methodology": pairs(spark, method),
        "3. Assumptions": population.assumptions(spark),
        "4. Assignment Guide": pairs(spark, guide),
        "5. Area Summary": placed.summary,
        "6. Readable Assignments": full.select(*readable),
        "7. Full Assignments": full,
        "8. Unreachable": lost.select("building_idx", "reason", "reason_text").orderBy("building_idx"),
        "9. Open Areas": roster,
    }
    if other is not None:
        out["10. Capacity Comparison"] = compared(placed, other)
    return out


def compared(one: Placement, two: Placement) -> DataFrame:
    """(figure, first, second, difference) of two placements, and how many open areas they share."""
    a, b = (placement_figures(x).select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("double")) for c in placement_figures(x).columns]))).alias("figure", "v")) for x in (one, two))
    rows = a.withColumnRenamed("v", "first").join(b.withColumnRenamed("v", "second"), "figure")
    first, second = set(one.solution.open_areas), set(two.solution.open_areas)
    more = [("cost", float(one.solution.cost), float(two.solution.cost)), ("open areas", float(len(first)), float(len(second))), ("open areas in both", float(len(first & second)), float(len(first & second)))]
    rows = rows.unionByName(a.sparkSession.createDataFrame(more, "figure string, first double, second double"))
    return rows.withColumn("difference", F.col("second") - F.col("first")).orderBy("figure")
