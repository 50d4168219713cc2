"""Registered queries of fingerprints, filters and small audits, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import geometry as geo
from geoloom.operators import analytics, population, signatures
from geoloom.plans.fixtures import oracle, view

_PART = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_TEXT = f"concat_ws('|', {', '.join(_PART.format(c) for c in ('building_idx', 'levels', 'name', 'neighbourhood'))})"
_HASH = f"CAST('0x' || substr(md5({_TEXT}), 1, 15) AS BIGINT)"
_COLUMNS = ["building_idx", "levels", "name", "neighbourhood"]


@query("fingerprint", oracle(f"SELECT count(*) AS n, CAST(sum({_HASH}) AS VARCHAR) AS total, bit_xor({_HASH}) AS mixed FROM f_buildings"))
def fingerprint(spark, d):
    return signatures.fingerprint(view(spark, d, "f_buildings"), _COLUMNS)


@query("fingerprint_shuffled", oracle(f"SELECT neighbourhood, count(*) AS n, CAST(sum({_HASH}) AS VARCHAR) AS total, bit_xor({_HASH}) AS mixed FROM f_buildings GROUP BY 1"))
def fingerprint_shuffled(spark, d):
    return signatures.fingerprints(view(spark, d, "f_buildings").repartition(7, "x"), "neighbourhood", columns=_COLUMNS)


@query("changed_groups", oracle("SELECT neighbourhood, CASE WHEN k = 3 THEN 'removed' WHEN k = 5 THEN 'added' WHEN hit THEN 'changed' ELSE 'same' END AS change FROM (SELECT neighbourhood, CAST(replace(neighbourhood, 'NATION_', '') AS INTEGER) % 7 AS k, bool_or(building_idx % 50 = 0) AS hit FROM f_buildings GROUP BY 1, 2)"))
def changed_groups(spark, d):
    """Neighbourhoods between two runs: one in seven is left out, one is new, in others a building of fifty has another level."""
    rows = view(spark, d, "f_buildings")
    k = F.regexp_extract("neighbourhood", "[0-9]+", 0).cast("int") % 7
    after = rows.where(k != 3).withColumn("levels", F.when(F.col("building_idx") % 50 == 0, F.coalesce("levels", F.lit(0)) + 1).otherwise(F.col("levels")))
    return signatures.changes(rows.where(k != 5), after.repartition(5), "neighbourhood", columns=_COLUMNS)


@query("selected_values", oracle("SELECT id FROM f_features WHERE (building IN ('school', 'yes') OR building IS NULL) AND neighbourhood IN ('NATION_1', 'NATION_4', 'NATION_7')"))
def selected_values(spark, d):
    chosen = {"building": ["school", "yes", None], "neighbourhood": ["NATION_1", "NATION_4", "NATION_7"], "brand": []}
    return analytics.select_values(view(spark, d, "f_features"), chosen).select("id")


@query("non_residential", oracle("SELECT count(*) FILTER (WHERE building = 'school') AS hits, count(*) AS n FROM f_features"))
def non_residential(spark, d):
    return analytics.count_values(view(spark, d, "f_features"), "building", population.NON_RESIDENTIAL)


@query("preview_8", oracle("SELECT building_idx, area_m2 FROM f_buildings ORDER BY area_m2 DESC NULLS LAST, building_idx LIMIT 8"))
def preview_8(spark, d):
    return analytics.preview(view(spark, d, "f_buildings"), [F.desc_nulls_last("area_m2"), "building_idx"]).select("building_idx", "area_m2")


@query("audit_tail", oracle("SELECT area_idx FROM (SELECT area_idx, row_number() OVER (ORDER BY area_m2 DESC NULLS LAST, area_idx) AS r, count(*) OVER () AS n FROM f_areas) WHERE r > n - 5"))
def audit_tail(spark, d):
    """The last five rows of an audit: those without a value."""
    rows = view(spark, d, "f_areas")
    return analytics.audit_order(rows, "area_m2", "area_idx").offset(max(0, rows.count() - 5)).select("area_idx")


@query("unmatched_names", oracle("SELECT n, array_to_string(first, ',') AS first FROM (SELECT count(*) AS n FROM (SELECT DISTINCT name FROM f_features WHERE building IS NULL)), (SELECT list(name ORDER BY name) AS first FROM (SELECT DISTINCT name FROM f_features WHERE building IS NULL ORDER BY name LIMIT 10))"))
def unmatched_names(spark, d):
    return analytics.sample_names(view(spark, d, "f_features").where("building is null"), "name").select("n", F.array_join("first", ",").alias("first"))


@query("shape_counts", oracle("SELECT count(*) FILTER (WHERE id % 3 = 0) AS polygons, count(*) FILTER (WHERE id % 3 = 1) AS points, count(*) FILTER (WHERE id % 3 = 2) AS bare FROM f_features"))
def shape_counts(spark, d):
    k = F.col("id") % 3
    rows = view(spark, d, "f_features").select(F.when(k == 0, geo.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))).alias("rings"), F.when(k == 1, F.col("id").cast("double")).alias("x"))
    return analytics.shape_counts(rows)


@query("open_and_closed", oracle("SELECT area_idx, name, area_idx % 4 = 0 AS is_open FROM f_areas"))
def open_and_closed(spark, d):
    areas = view(spark, d, "f_areas")
    opened, closed = analytics.split_open(areas, areas.where("area_idx % 4 = 0"))
    return opened.select("area_idx", "name", F.lit(True).alias("is_open")).unionByName(closed.select("area_idx", "name", F.lit(False).alias("is_open")))
