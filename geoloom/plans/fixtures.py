"""Map-like tables derived from the test tables: the same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "f_buildings": """SELECT c_custkey AS building_idx, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y,
        concat('NATION_', c_nationkey) AS neighbourhood, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(40 + (c_custkey * 37) % 460 AS DOUBLE) END AS area_m2,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1 + c_custkey % 9 AS INT) END AS levels,
        CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(c_mktsegment, ' ', c_custkey % 50) ELSE 'yes' END AS name FROM {customer}""",
    "f_areas": """SELECT CAST(s_suppkey AS INT) AS area_idx, CAST((s_suppkey * 7907) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104723) % 10009 AS DOUBLE) AS y, s_name AS name,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(200 + (s_suppkey * 131) % 6000 AS DOUBLE) END AS area_m2 FROM {supplier}""",
    "f_population": """SELECT CAST(n_nationkey AS BIGINT) AS ord, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat(lower(n_name), ' Mahallesi') ELSE concat(upper(n_name), ' MAH.') END AS mahalle_adi,
        CAST(2000 + 137 * n_nationkey AS DOUBLE) AS nufus FROM {nation} WHERE n_nationkey <> 24""",
    "f_polygons": """SELECT n_nationkey AS poly_id, n_nationkey AS poly_ord, n_name AS neighbourhood_name, CAST((n_nationkey % 5) * 2000 AS DOUBLE) AS x0, CAST((n_nationkey % 5) * 2000 + 2000 AS DOUBLE) AS x1,
        CAST(floor(n_nationkey / 5) * 2000 AS DOUBLE) AS y0, CAST(floor(n_nationkey / 5) * 2000 + 2000 AS DOUBLE) AS y1 FROM {nation}""",
    "f_features": """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS element,
        CASE WHEN p_type LIKE 'ECONOMY%' THEN 'residential' WHEN p_type LIKE 'STANDARD%' THEN 'apartments' WHEN p_type LIKE 'MEDIUM%' THEN 'yes' WHEN p_type LIKE 'SMALL%' THEN 'school' END AS building,
        CASE WHEN p_type LIKE 'PROMO%' THEN 'hospital' WHEN p_type LIKE 'SMALL%' AND p_size % 2 = 0 THEN 'school' END AS amenity, CASE WHEN p_type LIKE 'LARGE%' THEN 'park' END AS leisure,
        CASE WHEN p_size % 10 = 0 THEN CAST(p_size * 20 AS VARCHAR(20)) END AS capacity, p_name AS name, concat('NATION_', p_partkey % 25) AS neighbourhood, p_brand AS brand FROM {part}""",
    "f_edges": """SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey + 1 AS BIGINT) AS dst, CAST(100 + ((n_nationkey * 7 + (n_nationkey + 1) * 3) % 5) * 10 AS DOUBLE) AS length_m, n_nationkey % 4 = 0 AS oneway FROM {nation} WHERE n_nationkey % 5 < 4
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 5 AS BIGINT), CAST(100 + ((n_nationkey * 7 + (n_nationkey + 5) * 3) % 5) * 10 AS DOUBLE), n_nationkey % 4 = 0 FROM {nation} WHERE n_nationkey < 20
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 1 AS BIGINT), CAST(60 AS DOUBLE), true FROM {nation} WHERE n_nationkey % 5 < 4 AND n_nationkey % 3 = 1""",
    "f_nodes": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST((n_nationkey % 5) * 100 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) * 100 AS DOUBLE) AS y FROM {nation}",
    "f_places": """SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'x' WHEN c_custkey % 23 = 0 THEN '0' ELSE CAST(39 + (c_custkey % 31) * 0.125 AS VARCHAR(20)) END AS lat,
        CASE WHEN c_custkey % 29 = 0 THEN '200' WHEN c_custkey % 23 = 0 THEN '0' ELSE CAST(27 + (c_custkey % 37) * 0.125 AS VARCHAR(20)) END AS lon FROM {customer}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].replace("VARCHAR(20)", "STRING").format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names; one of this machine's own only where it names none and runs here alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp())


def oracle(sql: str) -> str:
    """The query with the views it names in front."""
    used = [n for n in VIEWS if n in sql]
    return "WITH " + ("RECURSIVE " if "RECURSIVE" in sql else "") + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in used) + ("," if sql.lstrip().startswith("RECURSIVE") else "") + " " + sql.replace("RECURSIVE ", "", 1)
