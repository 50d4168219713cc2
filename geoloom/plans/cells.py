"""Registered queries of column functions and small operators over whole tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import geometry as geo
from geoloom.functions import text
from geoloom.operators import analytics, location, names, network, population, registry, rules, spatial
from geoloom.operators.planar import Planar
from geoloom.plans.fixtures import oracle, view
from geoloom.sources import readers
from geoloom.sources.stored import Stored

_EMPTY = "('', 'nan', 'none', 'null')"


@query("normalized_cells", oracle(f"SELECT id, CASE WHEN coalesce(lower(trim(building)), '') IN {_EMPTY} THEN '' ELSE lower(trim(building)) END AS value, coalesce(lower(trim(capacity)), '') NOT IN {_EMPTY} AS filled, coalesce(lower(trim(capacity)), '') IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', '—') AS nothing FROM f_features"))
def normalized_cells(spark, d):
    return view(spark, d, "f_features").select("id", text.normalize_value("building").alias("value"), text.is_filled("capacity").alias("filled"), text.is_empty_input("capacity").alias("nothing"))


_FOLD = "trim(regexp_replace(regexp_replace(lower(strip_accents(translate(coalesce(text, ''), 'ıİ', 'ii'))), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = "('ve', 'and', 'the', 'of', 'ltd', 'sti', 'san', 'tic', 'as', 'prof', 'dr', 'doc', 'op', 'av')"


@query("folded_texts", f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def folded_texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.normalize_name("text").cast("binary")).alias("folded"))


@query("name_words", f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS canonical, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS sorted FROM (SELECT doc_id, list_filter(string_split({_FOLD}, ' '), lambda x: length(x) >= 2 AND x NOT IN {_STOP}) AS w FROM documents)")
def name_words(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(text.canonical(F.col("w")).cast("binary")).alias("canonical"), F.md5(text.sorted_canonical(F.col("w")).cast("binary")).alias("sorted"))


@query("place_words", oracle("SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN len(rest) > 0 THEN rest ELSE w END)), ' ') AS words FROM (SELECT id, string_split(name, ' ') AS w, list_filter(string_split(name, ' '), lambda x: x NOT IN ('red', 'blue', 'gear', 'bolt')) AS rest FROM f_features)"))
def place_words(spark, d):
    place = F.array(*map(F.lit, ("red", "blue", "gear", "bolt")))
    return view(spark, d, "f_features").select("id", F.array_join(F.array_sort(text.strip_place(text.tokens("name"), place)), " ").alias("words"))


@query("neighbourhood_agreement", oracle("SELECT p.ord, q.ord AS other, CASE WHEN q.ord = 0 THEN true ELSE p.ord = q.ord END AS agrees FROM f_population p CROSS JOIN f_population q"))
def neighbourhood_agreement(spark, d):
    """Each neighbourhood against each hint; the first hint says nothing but what all names share."""
    p = view(spark, d, "f_population").select("ord", text.neighbourhood_tokens(F.concat("mahalle_adi", F.lit(" mah"))).alias("a"))
    a = p.select("ord", "a")
    b = p.select(F.col("ord").alias("other"), F.when(F.col("ord") == 0, text.neighbourhood_tokens(F.lit("Mahallesi"))).otherwise(F.col("a")).alias("b"))
    return a.join(b, F.lit(True), "cross").select("ord", "other", text.neighbourhood_agrees(F.col("b"), F.col("a")).alias("agrees"))


@query("slugs", oracle("SELECT ord, trim(regexp_replace(regexp_replace(lower(mahalle_adi), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM f_population"))
def slugs(spark, d):
    return view(spark, d, "f_population").select("ord", text.slug("mahalle_adi").alias("slug"))


@query("score_labels", oracle("SELECT id, CASE WHEN id % 6 >= 4 THEN 'high' WHEN id % 6 >= 2 THEN 'medium' WHEN id % 6 >= 1 THEN 'low' ELSE 'none' END AS confidence, CASE WHEN id % 101 >= 80 THEN 'good' WHEN id % 101 >= 50 THEN 'fair' ELSE 'poor' END AS share FROM f_features"))
def score_labels(spark, d):
    return view(spark, d, "f_features").select("id", text.confidence_label(F.col("id") % 6).alias("confidence"), text.percent_band(F.col("id") % 101).alias("share"))


@query("name_variants", oracle("SELECT id, array_to_string(list_value(name) || CASE WHEN building IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_value(building) END || list_value(brand), '|') AS variants FROM f_features"))
def name_variants(spark, d):
    return view(spark, d, "f_features").select("id", F.array_join(text.name_variants(F.col("name"), [F.upper("name"), F.col("building"), F.initcap("name"), F.col("brand")]), "|").alias("variants"))


@query("pattern_hits", oracle("SELECT id, contains(name, 'd b') AS phrase, len(list_filter(string_split(name, ' '), lambda x: starts_with(x, 'wid') AND length(x) <= 7)) > 0 AS word FROM f_features"))
def pattern_hits(spark, d):
    return view(spark, d, "f_features").select("id", text.pattern_matches(F.lit("d b"), F.col("name")).alias("phrase"), text.pattern_matches(F.lit("wid"), F.col("name")).alias("word"))


@query("detected_categories", oracle("SELECT id AS k, CASE WHEN id % 4 = 0 THEN 'pharmacy' WHEN id % 4 = 1 THEN 'primary_school' WHEN id % 4 = 2 THEN 'park' END AS rule_code FROM f_features"))
def detected_categories(spark, d):
    kind = F.when(F.col("id") % 4 == 0, " Eczanesi").when(F.col("id") % 4 == 1, " İlkokulu").when(F.col("id") % 4 == 2, " Parkı").otherwise(" zzz")
    rows = view(spark, d, "f_features").select(F.col("id").alias("k"), F.concat(F.initcap("brand"), kind).alias("name"))
    return names.detect_category(rows, "name", names.pattern_table(spark, registry.name_patterns()), registry.UMBRELLAS, "k")


@query("name_length", "SELECT quantile_cont(length(text), 0.9) AS p90 FROM documents")
def name_length(spark, d):
    return analytics.name_length_p90(spark.read.parquet(f"{d}/documents.parquet"), "text")


_LATLON = "SELECT id, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM f_places"


@query("map_centre", oracle(f"SELECT CAST(round(avg(lat) * 1000000) AS BIGINT) AS lat, CAST(round(avg(lon) * 1000000) AS BIGINT) AS lon FROM ({_LATLON}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"))
def map_centre(spark, d):
    got = analytics.map_centre(spatial.valid_wgs84(view(spark, d, "f_places"), "lat", "lon"), "lat", "lon")
    return got.select(*[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in ("lat", "lon")])


_FILLED = ("building", "amenity", "leisure", "capacity", "name")


@query("fill_audit", oracle(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(round(count({c}) * 1000000.0 / count(*)) AS BIGINT) AS filled, count({c}) >= 0.8 * count(*) AS ok FROM f_features" for c in _FILLED)))
def fill_audit(spark, d):
    return analytics.fill_audit(view(spark, d, "f_features"), list(_FILLED)).withColumn("filled", F.round(F.col("filled") * 1000000).cast("long"))


@query("column_frequency", oracle("SELECT tag, n, round_even(n / CAST(t AS DOUBLE), 4) AS ratio FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS tag, count({c}) AS n, count(*) AS t FROM f_features" for c in _FILLED) + ") WHERE n > 0"))
def column_frequency(spark, d):
    return analytics.column_frequency(view(spark, d, "f_features"), list(_FILLED))


@query("run_delta", oracle("SELECT area_idx, CASE WHEN area_idx % 3 <> 0 THEN area_m2 END AS first, CASE WHEN area_idx % 4 <> 0 THEN area_m2 * 2 END AS second, CASE WHEN area_idx % 3 <> 0 AND area_idx % 4 <> 0 THEN area_m2 END AS delta FROM f_areas WHERE area_idx % 12 <> 0"))
def run_delta(spark, d):
    a = view(spark, d, "f_areas").select("area_idx", "area_m2")
    return analytics.delta(a.where("area_idx % 3 <> 0"), a.where("area_idx % 4 <> 0").withColumn("area_m2", F.col("area_m2") * 2), "area_idx", "area_m2")


@query("resolution_rate", oracle("SELECT CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(resolved) AS BIGINT) AS resolved, sum(resolved) / sum(raw) AS rate FROM (SELECT element, count(*) AS raw, count(amenity) AS resolved FROM f_features GROUP BY 1)"))
def resolution_rate(spark, d):
    return analytics.resolution(view(spark, d, "f_features").groupBy("element").agg(F.count("*").alias("raw"), F.count("amenity").alias("resolved")))


@query("prepared_buildings", oracle("SELECT building_idx, greatest(coalesce(area_m2, 0) * greatest(coalesce(levels, 4), 1), 1) AS weight, CAST(least(greatest(coalesce(levels, 4), 1), 60) AS INTEGER) AS levels FROM f_buildings"))
def prepared_buildings(spark, d):
    return population.prepare_buildings(_buildings(spark, d))[0].select("building_idx", "weight", "levels")


@query("levels_audit", oracle("SELECT neighbourhood, count(*) AS buildings, CASE WHEN n = 24 THEN NULL ELSE CAST(2000 + 137 * n AS DOUBLE) END AS population FROM (SELECT neighbourhood, CAST(replace(neighbourhood, 'NATION_', '') AS INTEGER) AS n FROM f_buildings) GROUP BY neighbourhood, n"))
def levels_audit(spark, d):
    b = view(spark, d, "f_buildings")
    totals = population.lookup_population(b, view(spark, d, "f_population"), "mahalle_adi", "nufus", "ord")
    return population.uniform_audit(b, totals).select("neighbourhood", "buildings", "population")


def _tagged(spark, d) -> DataFrame:
    keys = ["building", "amenity", "leisure", "name"]
    return view(spark, d, "f_features").withColumn("tags", F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull()))


@query("category_labels", oracle("SELECT id, CASE WHEN amenity IS NOT NULL THEN concat('amenity=', amenity) WHEN leisure IS NOT NULL THEN concat('leisure=', leisure) WHEN building IS NOT NULL THEN concat('building=', building) END AS label FROM f_features"))
def category_labels(spark, d):
    return _tagged(spark, d).select("id", F.nullif(names.category_label(F.col("tags")), F.lit("")).alias("label"))


@query("same_religion", oracle("SELECT id FROM f_features WHERE id % 3 <> 1"))
def same_religion(spark, d):
    faith = F.when(F.col("id") % 3 == 0, "muslim").when(F.col("id") % 3 == 1, "christian")
    rows = view(spark, d, "f_features").withColumn("tags", F.when(faith.isNotNull(), F.create_map(F.lit("religion"), faith)).otherwise(F.create_map(F.lit("amenity"), F.lit("place_of_worship"))))
    return rules.religion_filter(rows, "muslim").select("id")


@query("yes_buildings", oracle("SELECT id, CASE WHEN building = 'yes' AND id % 2 = 0 THEN 'hospital' WHEN building = 'yes' THEN 'building_yes_unresolved' WHEN building = 'school' THEN 'building_school' END AS rule_code, building IS NOT NULL AND (building = 'school' OR building = 'yes' AND id % 2 = 0) AS matched FROM f_features"))
def yes_buildings(spark, d):
    """building=yes is judged again by its other tags: an amenity gives it a rule, nothing leaves it unresolved."""
    tags = F.map_filter(F.create_map(F.lit("building"), F.when(F.col("building").isin("yes", "school"), F.col("building")), F.lit("amenity"), F.when((F.col("building") == "yes") & (F.col("id") % 2 == 0), "hospital")), lambda k, v: v.isNotNull())
    got = rules.classify(view(spark, d, "f_features").withColumn("tags", tags), [registry.BY_CODE["building_school"]], registry.RULES)
    return got.select("id", F.when(F.col("rule_code") == "building_hospital", "hospital").otherwise(F.col("rule_code")).alias("rule_code"), "matched")


_OD = "SELECT b.building_idx, a.area_idx, CAST(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * CAST(1.4 AS DOUBLE) / CAST(80.0 AS DOUBLE) AS FLOAT) AS minutes FROM f_buildings b CROSS JOIN f_areas a"
# Areas times 40, so that weights are whole numbers and none is a tie that the two engines could round in different ways.
_W = "greatest(coalesce(area_m2, 0) * greatest(coalesce(levels, 4), 1), 1)"


def _buildings(spark, d) -> DataFrame:
    return view(spark, d, "f_buildings").withColumn("area_m2", F.col("area_m2") * 40)


@query("limited_od", oracle(f"SELECT building_idx, count(*) AS areas FROM ({_OD}) WHERE minutes <= CAST(20 AS FLOAT) GROUP BY 1"))
def limited_od(spark, d):
    return network.planar_od(view(spark, d, "f_buildings"), view(spark, d, "f_areas"), limit=20).groupBy("building_idx").agg(F.count("*").alias("areas"))


@query("global_p95", oracle(f"SELECT CAST(min(minutes) AS DOUBLE) AS percentile FROM (SELECT minutes, sum(w) OVER (ORDER BY minutes) AS c, sum(w) OVER () AS t FROM (SELECT o.building_idx, min(minutes) AS minutes, any_value({_W.replace('area_m2', 'b.area_m2').replace('levels', 'b.levels')}) AS w FROM ({_OD}) o JOIN f_buildings b ON b.building_idx = o.building_idx GROUP BY 1)) WHERE c >= CAST(0.95 AS DOUBLE) * t"))
def global_p95(spark, d):
    good, _ = population.prepare_buildings(_buildings(spark, d))
    near = network.nearest_planar(good, view(spark, d, "f_areas")).join(good.select("building_idx", "weight"), "building_idx")
    return analytics.weighted_percentile(near, "minutes", "weight", 0.95).withColumn("percentile", F.col("percentile").cast("double"))


@query("best_area", oracle(f"SELECT area_idx, CAST(round(s) AS BIGINT) AS cost FROM (SELECT area_idx, sum(CAST(minutes AS DOUBLE) * w) AS s FROM ({_OD}) o JOIN (SELECT building_idx, {_W} AS w FROM f_buildings) b ON b.building_idx = o.building_idx GROUP BY 1) ORDER BY s, area_idx LIMIT 1"))
def best_area(spark, d):
    """The exact answer for one area, over all buildings and areas: bounds from sums in cells leave few areas to price by all buildings."""
    good, _ = population.prepare_buildings(_buildings(spark, d))
    stored = Stored(spark, "best")
    try:
        got = Planar.of(stored, good, population.prepare_areas(view(spark, d, "f_areas"))).best(stored, 1)
    finally:
        stored.clear()
    return spark.createDataFrame([(got[0][0], round(got[1]))] if got else [], "area_idx int, cost long")


@query("open_assignments", oracle(f"SELECT building_idx, area_idx, CAST(minutes AS DOUBLE) AS minutes, CASE WHEN minutes <= 5 THEN 'Excellent' WHEN minutes <= 10 THEN 'Good' WHEN minutes <= 15 THEN 'Acceptable' WHEN minutes <= 30 THEN 'Far' ELSE 'Very far' END AS band, w AS weight FROM (SELECT o.*, b.w, row_number() OVER (PARTITION BY o.building_idx ORDER BY minutes, area_idx) AS r FROM ({_OD}) o JOIN (SELECT building_idx, {_W} AS w FROM f_buildings) b ON b.building_idx = o.building_idx WHERE area_idx % 5 = 2) WHERE r = 1"))
def open_assignments(spark, d):
    good, _ = population.prepare_buildings(_buildings(spark, d))
    areas = population.prepare_areas(view(spark, d, "f_areas"))
    opened = areas.where("area_idx % 5 = 2")
    ways = network.nearest_ways(good, opened, 4)
    got = location.enriched(network.first_way(ways), None, good, areas, opened, network.next_ways(ways))
    return got.select("building_idx", "area_idx", F.col("minutes").cast("double").alias("minutes"), "band", "weight")


@query("latest_files", oracle("SELECT neighbourhood AS place, max(concat(neighbourhood, '_', lpad(CAST(building_idx AS VARCHAR), 8, '0'))) AS path FROM f_buildings GROUP BY 1"))
def latest_files(spark, d):
    rows = view(spark, d, "f_buildings").select(F.col("neighbourhood").alias("place"), F.concat("neighbourhood", F.lit("_"), F.lpad(F.col("building_idx").cast("string"), 8, "0")).alias("path"))
    return readers.latest_files(rows).select("place", "path")


@query("measured_polygons", oracle("SELECT poly_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area_m2 FROM f_polygons"))
def measured_polygons(spark, d):
    p = view(spark, d, "f_polygons").withColumn("rings", geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return p.select("poly_id", geo.area(F.col("rings")).alias("area_m2"))
