"""Registered queries against their oracles on the small tables, where these are at hand."""

import os

import pytest

import geoloom.catalog as catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ["area_summary", "coverage", "weighted_p95", "alternatives", "classify", "category_summary", "neighbourhood_pivot", "calibrated", "neighbourhood_assignment", "street_walk", "street_drive", "coordinate_audit", "union_dedup", "wide_od", "quality", "text_search", "name_lookup", "graph_health", "extraction", "best_area", "open_assignments", "prepared_buildings", "yes_buildings", "detected_categories", "name_words", "global_p95"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
