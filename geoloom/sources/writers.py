"""Sinks: feature collections, CSV, report tables, versioned graphs. Large results are written in parallel, as one folder of parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo


def feature_json(df: DataFrame, rings: str | None = "rings", x: str = "x", y: str = "y") -> DataFrame:
    """(feature): one GeoJSON feature per row, everything but the geometry as its properties."""
    number = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), number), ","), F.lit("]"))
    point = F.when(F.col(x).isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":['), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]}")))
    shape: Column = point
    if rings and rings in df.columns:
        polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(F.transform(F.col(rings), ring), ","), F.lit("]}"))
        shape = F.when(F.col(rings).isNotNull(), polygon).otherwise(point)
    properties = F.to_json(F.struct(*[c for c in df.columns if c not in (rings, x, y)]), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_geojson(df: DataFrame, path: str, **how) -> str:
    """Newline-delimited features; nothing is written for an empty table, and the answer then is the empty text."""
    if df.isEmpty():
        return ""
    feature_json(df, **how).write.mode("overwrite").text(path)
    return path


def for_csv(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons as WKT, other nested columns as JSON."""
    flat = [geo.wkt(c).alias(c) if c == rings else F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"`{c}`") for c in df.columns]
    return df.select(*flat)


def write_csv(df: DataFrame, path: str) -> str:
    if df.isEmpty():
        return ""
    for_csv(df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_classification(classified: DataFrame, path: str) -> dict[str, str]:
    """All, resolved and unresolved rows, each in both formats; the rows are computed once."""
    from geoloom.operators.rules import split_resolved

    rows = classified.persist()
    try:
        resolved, unresolved = split_resolved(rows)
        out = {}
        for name, part in (("classified", rows), ("resolved", resolved), ("unresolved", unresolved)):
            out[f"{name}.geojson"] = write_geojson(part, f"{path}/{name}.geojson")
            out[f"{name}.csv"] = write_csv(part, f"{path}/{name}.csv")
        return out
    finally:
        rows.unpersist()


def summary_text(figures: DataFrame) -> str:
    """Lines of `key: value` of a one-row table."""
    return "\n".join(f"{k}: {v}" for k, v in figures.first().asDict().items())


def summary_json(figures: DataFrame) -> str:
    return json.dumps(figures.first().asDict(), ensure_ascii=False, default=str)


def write_report(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One CSV folder per table, names made unique by a number from 2."""
    out: dict[str, str] = {}
    for name, df in tables.items():
        key, k = name[:31], 2
        while key in out:
            key, k = f"{name[:28]} {k}", k + 1
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{key}")
        out[key] = f"{path}/{key}"
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str, version: int) -> str:
    root = f"{path}/{mode}/v{version}"
    nodes.write.mode("overwrite").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").parquet(f"{root}/edges")
    return root


def prune_graphs(spark, path: str, mode: str, keep: int) -> int:
    """Deletes this mode's versions below `keep`; other modes stay."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{mode}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    if fs.exists(root):
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < keep:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone


def save_versioned(df: DataFrame, path: str, stamp: str) -> str:
    """Keeps what was there under a stamped name, then writes anew."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{stamp}"))
    df.write.text(path) if df.columns == ["feature"] else df.write.parquet(path)
    return path
