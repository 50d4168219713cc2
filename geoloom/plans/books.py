"""Registered queries of workbooks and their report tables: what is written is read back, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import text
from geoloom.plans import pipelines, registered, reports
from geoloom.plans.fixtures import oracle, view
from geoloom.plans.registered import milli
from geoloom.sources import workbook
from geoloom.sources.stored import Stored


def _book(spark) -> tuple[Stored, str]:
    stored = Stored(spark, "book")
    return stored, f"{stored.root}/book.xlsx"


@query("workbook_round_trip", oracle("SELECT CAST(building_idx AS VARCHAR) AS building_idx, CAST(CAST(x AS BIGINT) AS VARCHAR) AS x, CASE WHEN name <> '' THEN name END AS name, CAST(levels AS VARCHAR) AS levels, CASE WHEN levels > 3 THEN 'true' WHEN levels <= 3 THEN 'false' END AS high FROM f_buildings"))
def workbook_round_trip(spark, d):
    """All buildings as a sheet of a workbook, read back as text."""
    rows = view(spark, d, "f_buildings").select("building_idx", F.col("x").cast("long").alias("x"), F.nullif("name", F.lit("")).alias("name"), "levels", (F.col("levels") > 3).alias("high"))
    stored, path = _book(spark)
    workbook.write_workbook({"Summary": spark.range(1), "Buildings & more": rows}, path, split=True)
    kept = stored.keep(workbook.table(workbook.read_workbooks(spark, path, "Buildings & more")))
    return kept.select("building_idx", "x", "name", "levels", "high")


_ROWS = registered._REPORT
_SHEETS = " UNION ALL ".join([f"SELECT 'Summary' AS sheet, count(DISTINCT category) + 2 AS n FROM ({_ROWS})", f"SELECT 'Neighborhood Pivot', count(DISTINCT neighbourhood) + 2 FROM ({_ROWS})", f"SELECT 'Data Quality', count(DISTINCT category) + 1 FROM ({_ROWS})", *[f"SELECT '{c}', count(*) + 1 FROM ({_ROWS}) WHERE category = '{c}'" for c in registered._CATEGORIES]])


@query("report_workbook", oracle(f"SELECT sheet, CAST(n AS BIGINT) AS n FROM ({_SHEETS})"))
def report_workbook(spark, d):
    """Rows by sheet of the extraction report, headers included, from the stored workbook."""
    stored, path = _book(spark)
    workbook.write_workbook(reports.extraction_tables(registered._report_rows(spark, d), registered._CATEGORIES), path, split=True)
    rows = workbook.read_workbooks(spark, path).where("row >= 0")
    return stored.keep(rows.groupBy("sheet").agg(F.count("*").alias("n")))


_TOTAL = ", ".join(f"CAST(sum({c}) AS BIGINT)" for c in [*registered._CATEGORIES, "TOTAL"])
_PIVOT = f"SELECT neighbourhood, {registered._PIVOT}, count(*) AS TOTAL FROM ({_ROWS}) WHERE neighbourhood IS NOT NULL GROUP BY 1"


@query("pivot_with_total", oracle(f"SELECT * FROM ({_PIVOT}) UNION ALL SELECT 'TOTAL', {_TOTAL} FROM ({_PIVOT})"))
def pivot_with_total(spark, d):
    return reports.extraction_tables(registered._report_rows(spark, d), registered._CATEGORIES)["Neighborhood Pivot"]


_N = registered._NEAREST
_FIGURES = ", ".join(f"CAST(round(avg(CASE WHEN minutes <= {x} THEN 1 ELSE 0 END) * 100 * 1000) AS BIGINT) AS within_{x}_pct, CAST(round(sum(CASE WHEN minutes <= {x} THEN weight ELSE 0 END) / sum(weight) * 100 * 1000) AS BIGINT) AS within_{x}_people_pct" for x in (5, 10, 30))


@query("placement_figures", oracle(f"SELECT count(*) AS assigned, CAST(round(sum(weight) * 1000) AS BIGINT) AS people, CAST(round(avg(m) * 1000) AS BIGINT) AS mean_minutes, CAST(round(max(m) * 1000) AS BIGINT) AS max_minutes, CAST(round(quantile_cont(m, 0.95) * 1000) AS BIGINT) AS p95_minutes, count(*) FILTER (WHERE m > 15) AS far, count(*) FILTER (WHERE m <= 5) AS excellent, CAST(round(sum(weight * m) / sum(weight) * 1000) AS BIGINT) AS mean_minutes_people, CAST(round(sum(weight * m) * 1000) AS BIGINT) AS weighted_minutes, {_FIGURES} FROM (SELECT *, CAST(minutes AS DOUBLE) AS m FROM ({_N}))"))
def placement_figures(spark, d):
    """The summary sheet's figures where all areas are open."""
    placed = pipelines.Placement(None, registered._assigned(spark, d), None, None, None)
    got = reports.placement_figures(placed)
    whole = ("assigned", "far", "excellent")
    return got.select(*[F.col(c).alias(c) if c in whole else milli(c).alias(c) for c in got.columns])


@query("time_band_counts", oracle(f"SELECT count(*) FILTER (WHERE minutes <= 5) AS excellent, count(*) FILTER (WHERE minutes > 15) AS far, count(*) FILTER (WHERE minutes > 30) AS very_far FROM ({_N})"))
def time_band_counts(spark, d):
    band = text.time_band("minutes")
    return registered._assigned(spark, d).agg(F.count_if(band == "Excellent").alias("excellent"), F.count_if(band.isin("Far", "Very far")).alias("far"), F.count_if(band == "Very far").alias("very_far"))
