"""Projection of classified features for export: columns by family, numbers coerced, values translated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import lookup, lookup_or_same

# Columns of every export, of places with a shape, and of each family.
COMMON = ["element", "id", "name", "category_group", "subcategory", "label_tr", "rule_code", "confidence", "reason", "latitude", "longitude", "neighbourhood", "boundary_status"]
SHAPE = ["building:levels", "height", "footprint_m2", "area_source"]
POI = ["amenity", "shop", "office", "tourism", "religion", "healthcare", "public_transport", "railway"]
FAMILIES = {"building": [*COMMON, "building", *POI, *SHAPE], "poi": [*COMMON, *POI, *SHAPE], "landuse": [*COMMON, "landuse", "leisure", "natural", *SHAPE], "network": [*COMMON, "highway", "railway", "bridge"], "admin": COMMON, "generic": COMMON}
FAMILIES |= {"transport": FAMILIES["poi"], "culture": FAMILIES["poi"], "infrastructure": FAMILIES["poi"], "derived": FAMILIES["building"]}
NUMBERS = ["latitude", "longitude", "footprint_m2", "building:levels"]

# Turkish words for tag values, confidences, reasons and element kinds.
BUILDING = {"residential": "Konut", "apartments": "Apartman", "house": "Müstakil Ev", "detached": "Villa", "terrace": "Sıra Ev", "commercial": "Ticari Bina", "office": "Ofis Binası", "retail": "AVM / Mağaza", "industrial": "Endüstriyel", "warehouse": "Depo", "hospital": "Hastane Binası", "school": "Okul Binası", "university": "Üniversite Binası", "public": "Kamu Binası", "civic": "Belediye Binası", "police": "Karakol", "fire_station": "İtfaiye", "garage": "Garaj", "garages": "Garaj", "mosque": "Cami", "church": "Kilise", "synagogue": "Sinagog", "yes": "Belirsiz", "": "-"}
CONFIDENCE = {"high": "Yüksek", "medium": "Orta", "low": "Düşük", "none": "Belirsiz"}
RELIGION = {"muslim": "İslam", "christian": "Hristiyanlık", "jewish": "Yahudilik", "": "-"}
ELEMENT = {"node": "Nokta", "way": "Yol/Alan", "relation": "İlişki"}
REASON = {"strict_match": "Kesin eşleşme", "support_match": "Destekleyici eşleşme", "name_fallback": "Ad eşleşmesi", "no_match": "Eşleşme yok", "building_yes_mapped:strict_match": "yes → kesin kategori", "building_yes_mapped:support_match": "yes → destekleyici kategori", "building_yes_mapped:name_fallback": "yes → ad ile kategori"}
VALUES = {"building": BUILDING, "religion": RELIGION, "confidence": CONFIDENCE, "reason": REASON, "element": ELEMENT}


def columns_of(family: str) -> list[str]:
    return FAMILIES.get(family, COMMON)


def ensure_core(df: DataFrame) -> DataFrame:
    """Missing core columns as typed nulls."""
    core = {"latitude": "double", "longitude": "double", "neighbourhood": "string", "footprint_m2": "double", "confidence": "string"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in core.items() if c not in df.columns})


def export_view(classified: DataFrame, family: str, tags: str = "tags", translate: bool = True) -> DataFrame:
    """The family's columns with a fixed schema: tag columns come from the map, numbers are coerced, height is read from its text."""
    rows = ensure_core(classified)
    out = []
    for c in columns_of(family):
        value = F.col(f"`{c}`") if c in rows.columns else F.try_element_at(F.col(tags), F.lit(c))
        if c in NUMBERS:
            value = value.cast("string").try_cast("double")
        elif c == "height":
            value = F.nullif(F.regexp_extract(value.cast("string"), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
        if c == "footprint_m2":
            value = F.bround(value, 1)
        if translate and c in VALUES:
            value = lookup(value, VALUES[c])
        out.append(value.alias(c))
    return rows.select(*out)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold nothing (one pass): for final files only, as it makes the schema depend on the rows."""
    n = df.agg(*[F.count(f"`{c}`").alias(str(k)) for k, c in enumerate(df.columns)]).first()
    return df.select(*[f"`{c}`" for k, c in enumerate(df.columns) if n[k]])


def to_english(df: DataFrame, columns: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """Renamed columns, a repeat gets " (2)" and so on; values by table, others stay."""
    taken: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = columns.get(c, c)
        taken[name] = taken.get(name, 0) + 1
        value = lookup_or_same(F.col(f"`{c}`"), values[c]) if c in values else F.col(f"`{c}`")
        out.append(value.alias(name if taken[name] == 1 else f"{name} ({taken[name]})"))
    return df.select(*out)
