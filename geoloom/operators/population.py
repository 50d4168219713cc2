"""Population and capacity estimates, and their agreement with official neighbourhood totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.text import col, normalize_neighbourhood

PER_SQUARE_METRE, LEVELS, AREA_EACH, LEAST_CAPACITY, FALLBACK_AREA, UNKNOWN = 0.025, 4, 1.5, 50.0, 1000.0, "Bilinmeyen"
# Occupancy words that mark a building without residents.
NON_RESIDENTIAL = ["commercial", "office", "retail", "industrial", "warehouse", "hospital", "school", "university", "mosque", "church", "garage", "garages"]


def estimate_population(area: Column | str, levels: Column | str, per_m2: float = PER_SQUARE_METRE, least: float = 1.0) -> Column:
    return F.greatest(F.coalesce(col(area), F.lit(0.0)) * F.greatest(F.coalesce(col(levels), F.lit(LEVELS)), F.lit(1)) * F.lit(per_m2), F.lit(least))


def estimate_capacity(area: Column | str, each: float = AREA_EACH, least: float = LEAST_CAPACITY) -> Column:
    """Clipped, then rounded half to even."""
    return F.bround(F.greatest(col(area) / F.lit(each), F.lit(least)), 0).cast("long")


def clip_levels(levels: Column | str) -> Column:
    return F.least(F.greatest(F.coalesce(col(levels).cast("int"), F.lit(LEVELS)), F.lit(1)), F.lit(60))


def prepare_areas(areas: DataFrame, geometry_area: Column | None = None, each: float = AREA_EACH) -> DataFrame:
    """Adds capacity and area_source: own area if positive, else the polygon's, else a fallback. Areas are rounded last."""
    measured, shape = F.col("area_m2") > 0, geometry_area if geometry_area is not None else F.lit(None).cast("double")
    used = F.when(measured, F.col("area_m2")).when(shape > 0, shape).otherwise(FALLBACK_AREA)
    source = F.when(measured, "measured").when(shape > 0, "geometry_measured").otherwise("estimated")
    return areas.withColumn("area_source", source).withColumn("capacity", estimate_capacity(used, each)).withColumn("area_m2", F.bround(used, 0))


def _totals(table: DataFrame, key: Column, name: str, value: str, order: str) -> DataFrame:
    """Last row of each key by order, if its population is positive."""
    got = table.select(key.alias("k"), F.col(value).cast("double").alias("pop"), F.col(order).alias("o")).where("k is not null and k <> ''")
    return got.groupBy("k").agg(F.max_by("pop", "o").alias("pop")).where("pop > 0")


def lookup_population(neighbourhoods: DataFrame, table: DataFrame, name: str, value: str, order: str, fuzzy: float | None = None) -> DataFrame:
    """(neighbourhood, population, match) of distinct names: exact, normalised, then, if asked for, the most similar."""
    names = neighbourhoods.select("neighbourhood").where("neighbourhood is not null").distinct()
    exact = _totals(table, F.trim(F.col(name)), name, value, order).select(F.col("k").alias("ke"), F.col("pop").alias("pe"))
    norm = _totals(table, normalize_neighbourhood(name), name, value, order).select(F.col("k").alias("kn"), F.col("pop").alias("pn"))
    got = names.withColumn("n", normalize_neighbourhood("neighbourhood")).join(exact, F.trim("neighbourhood") == F.col("ke"), "left").join(norm, F.col("n") == F.col("kn"), "left")
    out = got.select("neighbourhood", "n", F.coalesce("pe", "pn").alias("population"), F.when(F.col("pe").isNotNull(), "exact").when(F.col("pn").isNotNull(), "normalized").otherwise("unmatched").alias("match"))
    if fuzzy is None:
        return out.drop("n")
    from geoloom.operators.names import token_set_ratio

    left = out.where("match = 'unmatched'").withColumn("t", F.explode(F.array_distinct(F.split("n", " "))))
    right = norm.withColumn("t", F.explode(F.array_distinct(F.split("kn", " "))))
    # Names without a common word can't reach a useful ratio, so an equi-join on words finds the candidates.
    pairs = left.join(right, "t").select("neighbourhood", "n", "kn", "pn").distinct().withColumn("r", token_set_ratio("n", "kn")).where(F.col("r") >= fuzzy)
    best = pairs.groupBy("neighbourhood").agg(F.max(F.struct("r", "kn", "pn")).alias("b")).select(F.col("neighbourhood").alias("nb"), F.col("b.pn").alias("pf"))
    return out.join(best, F.col("neighbourhood") == F.col("nb"), "left").select("neighbourhood", F.coalesce("population", "pf").alias("population"), F.when((F.col("match") == "unmatched") & F.col("pf").isNotNull(), "fuzzy").otherwise(F.col("match")).alias("match"))


def uniform_weights(buildings: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds weight: a neighbourhood's population over its number of buildings; null where unmatched."""
    n = buildings.groupBy("neighbourhood").agg(F.count("*").alias("_n"))
    per = n.join(totals, "neighbourhood", "left").select("neighbourhood", (F.col("population") / F.col("_n")).alias("weight"))
    return buildings.drop("weight").join(per, "neighbourhood", "left")


def uniform_audit(buildings: DataFrame, totals: DataFrame) -> DataFrame:
    n = buildings.groupBy("neighbourhood").agg(F.count("*").alias("buildings"))
    return n.join(totals, "neighbourhood", "left").select("neighbourhood", "buildings", "population", F.coalesce("match", F.lit("unmatched")).alias("match"), (F.col("population") / F.col("buildings")).alias("per_building"))


def calibrate(buildings: DataFrame, totals: DataFrame) -> DataFrame:
    """Scales weights to official totals; unmatched or weightless neighbourhoods keep the estimate. Adds pop_source."""
    sums = buildings.groupBy("neighbourhood").agg(F.sum("weight").alias("_s")).join(totals, "neighbourhood", "left").select("neighbourhood", "_s", "population", "match")
    good = (F.col("_s") > 0) & F.col("population").isNotNull()
    out = buildings.join(sums, "neighbourhood", "left")
    return out.withColumn("weight", F.when(good, F.col("weight") * F.col("population") / F.col("_s")).otherwise(F.col("weight"))).withColumn("pop_source", F.when(good, F.concat(F.lit("official_"), F.col("match"))).otherwise("estimated")).drop("_s", "population", "match")


def calibration_audit(buildings: DataFrame, totals: DataFrame) -> DataFrame:
    sums = buildings.groupBy("neighbourhood").agg(F.count("*").alias("buildings"), F.sum("weight").alias("estimate"))
    return sums.join(totals, "neighbourhood", "left").withColumn("factor", F.when((F.col("estimate") > 0) & F.col("population").isNotNull(), F.col("population") / F.col("estimate"))).orderBy(F.desc_nulls_last("factor"), "neighbourhood")


def building_labels(buildings: DataFrame, name: str = "name", order: str = "building_idx") -> DataFrame:
    """Adds label: a meaningful name (50 letters, repeats numbered from 2), else the neighbourhood's running number."""
    n = F.trim(F.coalesce(F.col(name), F.lit("")))
    good = ~F.lower(n).isin("", "nan", "none", "null", "yes", "no")
    cut = F.substring(n, 1, 50)
    out = buildings.withColumn("_g", good).withColumn("_c", F.when(good, cut))
    k = F.row_number().over(Window.partitionBy("_g", F.coalesce("_c", "neighbourhood")).orderBy(order))
    area = F.coalesce("neighbourhood", F.lit(UNKNOWN))
    suffix = F.when(F.lower(area).rlike(r"( mh\.?| mah\.?| mahallesi)$"), area).otherwise(F.concat(area, F.lit(" Mh.")))
    return out.withColumn("_k", k).withColumn("label", F.when(F.col("_g"), F.when(F.col("_k") == 1, F.col("_c")).otherwise(F.concat("_c", F.lit(" #"), "_k"))).otherwise(F.concat(suffix, F.lit(" #"), "_k"))).drop("_g", "_c", "_k")


def prepare_buildings(buildings: DataFrame, totals: DataFrame | None = None, method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(usable, dropped): weights by footprint or uniform, rounded to a tenth; rows without a weight are set apart."""
    if method == "auto":
        method = "footprint" if buildings.agg(F.max("area_m2") > 0).first()[0] else "uniform"
    if method == "uniform":
        if totals is None:
            raise ValueError("uniform weights need a population table")
        out = uniform_weights(buildings, totals)
    else:
        out = buildings.withColumn("weight", estimate_population("area_m2", "levels"))
    out = out.withColumn("weight", F.bround("weight", 1)).withColumn("levels", clip_levels("levels")).withColumn("neighbourhood", F.coalesce("neighbourhood", F.lit(UNKNOWN)))
    return out.where("weight is not null"), out.where("weight is null")


def assumptions(spark) -> DataFrame:
    rows = [("people per square metre of floor", PER_SQUARE_METRE), ("levels where unknown", float(LEVELS)), ("square metres each", AREA_EACH), ("least capacity", LEAST_CAPACITY), ("area where unknown", FALLBACK_AREA), ("least people a building", 1.0)]
    return spark.createDataFrame(rows, "assumption string, value double")


def assumptions_applied(buildings: DataFrame, areas: DataFrame) -> DataFrame:
    """(assumption, value, applies): with the number of buildings or areas whose figures rest on it."""
    known, has = F.col("area_m2").isNotNull(), F.coalesce(F.col("area_m2") > 0, F.lit(False))
    people = F.coalesce("area_m2", F.lit(0.0)) * F.greatest(F.coalesce("levels", F.lit(LEVELS)), F.lit(1)) * F.lit(PER_SQUARE_METRE)
    b = buildings.agg(F.count_if(known).alias("people per square metre of floor"), F.count_if(F.col("levels").isNull()).alias("levels where unknown"), F.count_if(people < 1).alias("least people a building"))
    a = areas.agg(F.count_if(has).alias("square metres each"), F.count_if(has & (F.col("area_m2") < LEAST_CAPACITY * AREA_EACH)).alias("least capacity"), F.count_if(~has).alias("area where unknown"))
    counted = [x.unpivot([], x.columns, "assumption", "applies") for x in (b, a)]
    return assumptions(buildings.sparkSession).join(counted[0].unionByName(counted[1]), "assumption")
