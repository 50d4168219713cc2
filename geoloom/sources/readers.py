"""Readers: map features in GeoJSON, tables with loose headers, graphs, rules, listings. All go through Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geometry as geo
from geoloom.functions.text import slug
from geoloom.operators.analytics import number_blanks
from geoloom.operators.rules import Rule, condition, matches_any

# Column names that the loaders understand, in order of preference.
ALIASES = {
    "latitude": ["Latitude", "latitude", "lat", "Enlem", "enlem"],
    "longitude": ["Longitude", "longitude", "lon", "lng", "Boylam", "boylam"],
    "name": ["Name", "name", "Ad", "ad", "İsim", "isim"],
    "neighbourhood": ["Neighbourhood", "neighbourhood", "Neighborhood", "Mahalle", "mahalle", "neighbourhood_name"],
    "area_m2": ["Area (m²)", "area_m2", "Alan (m²)", "alan_m2", "footprint_m2"],
    "levels": ["Floors", "levels", "building:levels", "Kat Sayısı", "kat_sayisi"],
    "osm_id": ["OSM ID", "osm_id", "id"],
    "population": ["population", "Population", "nufus", "Nüfus", "nüfus"],
}
_GEOJSON = "features array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"


def pick_column(columns: list[str], role: str) -> str | None:
    """The first alias that is there, else a column whose name holds one, whatever the case."""
    for a in ALIASES[role]:
        if a in columns:
            return a
    low = {c.lower(): c for c in columns}
    return next((low[c] for a in ALIASES[role] for c in low if len(a) > 3 and a.lower() in c), None)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections: source, ord, properties (JSON), gtype, rings or x, y. Coordinates stay as they are.

    A file is parsed as one value, as the format has no record boundaries; directories of files are read in parallel.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    one = raw.select("source", F.posexplode(F.from_json("value", _GEOJSON)["features"]).alias("ord", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    nested = lambda depth: "array<" * depth + "double" + ">" * depth
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    polygon = F.transform(F.from_json(text, nested(3)), ring)
    multi = F.transform(F.flatten(F.from_json(text, nested(4))), ring)
    point = F.from_json(text, nested(1))
    return one.select(
        "source",
        "ord",
        F.col("f.id").alias("feature_id"),
        F.col("f.properties").alias("properties"),
        kind.alias("gtype"),
        F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi).alias("rings"),
        F.when(kind == "Point", F.get(point, F.lit(0))).alias("x"),
        F.when(kind == "Point", F.get(point, F.lit(1))).alias("y"),
    )


def read_neighbourhoods(spark: SparkSession, path: str, district: str) -> DataFrame:
    """Polygons only: neighbourhood_name (tags.name, name, name:tr, local_name, else numbered), district, poly_ord, rings."""
    rows = read_geojson(spark, path).withColumn("rings", geo.clean_polygon("rings")).where("gtype in ('Polygon', 'MultiPolygon') and rings is not null")
    got = [F.nullif(F.trim(F.get_json_object("properties", p)), F.lit("")) for p in ("$.tags.name", "$.name", "$['name:tr']", "$.local_name")]
    named = rows.select(F.coalesce(*got, F.lit("")).alias("neighbourhood_name"), F.lit(district).alias("district"), "ord", "rings")
    return number_blanks(named, "neighbourhood_name", "ord", f"{district} Mah. ").withColumnRenamed("ord", "poly_ord")


def filter_district(neighbourhoods: DataFrame, name_col: str, district_col: str | None = None, district: str | None = None) -> DataFrame:
    out = neighbourhoods.where(F.col(district_col) == district) if district_col and district else neighbourhoods
    return out.withColumnRenamed(name_col, "neighbourhood_name")


def read_features(spark: SparkSession, path: str, rules: list[Rule], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Stored features (element, id, tags, latitude, longitude, ...) that any of the rules' queries wants: one scan, one predicate.

    The box (south, north, west, east) is on plain columns and reaches the files.
    """
    rows = spark.read.parquet(path)
    if box:
        rows = rows.where(F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3]))
    return rows.where(matches_any(F.col("tags"), [d for r in rules for d in r.query]))


def raw_buildings(features: DataFrame) -> DataFrame:
    return features.where(condition(F.col("tags"), "building", "*") & F.col("gtype").isin("Polygon", "MultiPolygon"))


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks with differing columns by name, each row with its chunk's number, so that 'first' has a meaning."""
    out = None
    for k, c in enumerate(chunks):
        c = c.withColumn("chunk", F.lit(k))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    if out is None:
        raise ValueError("no chunk")
    return out


def read_loose_csv(spark: SparkSession, path: str, hints: tuple[str, ...] = ("lat", "lon", "enlem", "boylam")) -> DataFrame:
    """A table whose header is in its first or second line: the one whose names hint at coordinates. All columns are text."""
    best = None
    for skip in (0, 1):
        lines = spark.read.text(path).limit(skip + 1).collect()
        if len(lines) <= skip:
            continue
        names = [x.strip().strip('"') for x in lines[skip][0].split(",")]
        if any(h in n.lower() for n in names for h in hints):
            best = (skip, names)
            break
    if best is None:
        return spark.read.csv(path, header=True)
    skip, names = best
    rows = spark.read.csv(path, schema=", ".join(f"`{n or f'_c{k}'}` string" for k, n in enumerate(names)), mode="PERMISSIVE")
    header = [F.col(f"`{n or f'_c{k}'}`") == n for k, n in enumerate(names)]
    is_header = header[0]
    for h in header[1:]:
        is_header = is_header & h
    out = rows.where(~F.coalesce(is_header, F.lit(False)))
    if skip:
        title = lines[0][0].split(",")[0].strip().strip('"')
        out = out.where(~F.coalesce((F.col(f"`{names[0]}`") == title) & F.lit(title != names[0]), F.lit(False)))
    return out


def standard_columns(rows: DataFrame, roles: list[str], keep: list[str] | None = None) -> DataFrame:
    """The roles' columns under fixed names, null where no alias is found; those to keep as they are."""
    return rows.select(*(keep or []), *[(F.col(f"`{c}`") if (c := pick_column(rows.columns, r)) else F.lit(None).cast("string")).alias(r) for r in roles])


def pick_sheet(tables: dict[str, DataFrame]) -> str:
    """The table that looks most like a name list: ten points for a name-like column, one per hundred distinct filled values in it."""
    scores = {}
    for key, df in tables.items():
        c = pick_column(df.columns, "name")
        n = df.where(F.trim(F.col(f"`{c or df.columns[0]}`")) != "").select(F.countDistinct(f"`{c or df.columns[0]}`")).first()[0] if df.columns else 0
        scores[key] = (10 if c else 0) + n / 100
    return max(scores, key=scores.get)


def population_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """(name, value) columns: by alias, else the first column that is a number in at least 70 percent of its rows."""
    name, value = pick_column(df.columns, "neighbourhood") or pick_column(df.columns, "name"), pick_column(df.columns, "population")
    if value is None and df.columns:
        share = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull().cast("double")).alias(str(k)) for k, c in enumerate(df.columns)]).first()
        value = next((c for k, c in enumerate(df.columns) if c != name and (share[k] or 0) >= 0.7), None)
    return name or next((c for c in df.columns if c != value), None), value


def read_graph(spark: SparkSession, path: str, mode: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a versioned folder written by write_graph."""
    if mode not in ("walk", "drive"):
        raise ValueError("mode must be walk or drive")
    root = f"{path}/{mode}/v{version}"
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Expected lookups: ids split at bars, incomplete rows marked."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("expected_ids", F.filter(F.split(F.coalesce("expected_osm_id", F.lit("")), r"\|"), lambda x: x != "")).withColumn("incomplete", F.exists("expected_ids", lambda x: F.contains(F.upper(x), F.lit("TODO"))))


def list_files(spark: SparkSession, folder: str, ending: str = ".geojson") -> DataFrame:
    """(place, path, modified, size) of a folder's files, by place; contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.select(slug(F.regexp_extract("path", rf"([^/]+){re.escape(ending)}$", 1)).alias("place"), "path", "modified", "size").orderBy("place")


def file_status(districts: DataFrame, files: DataFrame, district: str = "district") -> DataFrame:
    """Every district with its file, if there is one."""
    return districts.withColumn("place", slug(district)).join(files, "place", "left").withColumn("missing", F.col("path").isNull())


def latest_files(files: DataFrame, key: str = "place", path: str = "path") -> DataFrame:
    """The last path by name of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(path)))
    return files.withColumn("_r", rank).where("_r = 1").drop("_r")


_POINT = "struct<lat:double,lon:double>"
_ANSWER = f"elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<{_POINT}>,members:array<struct<type:string,role:string,geometry:array<{_POINT}>>>>>"


def _place(path: Column | str) -> Column:
    return slug(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Neighbourhood polygons of stored map server answers: place, element, id, neighbourhood_name, part, rings, open_ways.

    Closed ways and relations are taken; ways of a relation are joined at their ends. Coordinates stay degrees (x is the longitude). What
    closes no ring has null rings.
    """
    from geoloom.operators.overlay import assemble

    raw = spark.read.text(path, wholetext=True).select(_place(F.input_file_name()).alias("place"), F.explode(F.from_json("value", _ANSWER)["elements"]).alias("e"))
    rows = raw.where("e.type in ('way', 'relation')").select(F.concat_ws("/", "place", "e.type", F.col("e.id").cast("string")).alias("key"), "place", F.col("e.type").alias("element"), F.col("e.id").alias("id"), F.try_element_at("e.tags", F.lit("name")).alias("neighbourhood_name"), "e.geometry", "e.members")
    lines = F.when(F.col("element") == "way", F.array("geometry")).otherwise(F.transform(F.filter("members", lambda m: m["type"] == "way"), lambda m: m["geometry"]))
    ways = rows.select("key", F.explode_outer(lines).alias("w")).select("key", F.transform("w", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("points"))
    return rows.drop("geometry", "members").join(assemble(ways, "key"), "key").drop("key")


def boundary_status(spark: SparkSession, path: str, boundaries: DataFrame) -> DataFrame:
    """One row a stored answer: place, features, polygons, and the error where it holds no polygon."""
    files = spark.read.format("binaryFile").load(path).select(_place("path").alias("place")).distinct()
    got = boundaries.groupBy("place").agg(F.countDistinct("element", "id").alias("features"), F.count("rings").alias("polygons"))
    out = files.join(got, "place", "left").na.fill(0, ["features", "polygons"])
    return out.withColumn("error", F.when(F.col("polygons") == 0, "no polygon"))
