"""Union, repair and ring assembly against point tests, hand results and their own sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import overlay, spatial
from geoloom.plans.fixtures import ensure_checkpoints
from geoloom.sources import readers

SHAPES = f"k int, rings {geo.POLYGON}"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def square(x, y, s):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def star(rnd, centre, size, corners):
    turn = np.sort(rnd.uniform(0, 2 * np.pi, corners))
    return ring(*(centre + np.stack([np.cos(turn), np.sin(turn)], 1) * rnd.uniform(0.4, 1, corners)[:, None] * size))


def holds(rings, points):
    """Even-odd test of points against rings of (n, 2) corners."""
    over = np.zeros(len(points), int)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, 0), strict=True):
            hit = (a[1] <= points[:, 1]) != (b[1] <= points[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                over += hit & (a[0] + (points[:, 1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > points[:, 0])
    return over % 2 == 1


def corners(r):
    return np.array([(p["x"], p["y"]) for p in r])


@pytest.mark.parametrize("cell", [None, 11.0, 500.0])
def test_union_of_random_polygons(spark, cell):
    ensure_checkpoints(spark)
    rnd = np.random.default_rng(3)
    shapes = [[star(rnd, rnd.uniform(0, 100, 2), rnd.uniform(5, 30), rnd.integers(5, 12))] for _ in range(14)]
    shapes += [[square(-30, -30, 25), square(-25, -25, 10)], [square(-20, -20, 4)], [square(-20, -20, 4)], [square(200, 0, 10)], [square(210, 0, 10)], [square(220, 10, 10)]]
    rows = spark.createDataFrame(list(enumerate(shapes)) + [(99, None), (98, [])], SHAPES)
    pieces = overlay.union_boundary(rows, cell=cell)
    figures = overlay.boundary_figures(pieces).first()
    rings = [corners(r) for row in overlay.union_rings(pieces).collect() for r in row.rings]
    assert abs(sum(overlay._signed(r) for r in rings) - figures.area) < 1e-3
    points = rnd.uniform(-40, 240, (20000, 2))
    want = np.zeros(len(points), bool)
    for s in shapes:
        want |= holds([corners(r) for r in s], points)
    assert (holds(rings, points) == want).all()


def test_union_of_squares_that_share_sides(spark):
    rows = spark.createDataFrame([(i * 4 + j, [square(i * 10, j * 10, 10)]) for i in range(4) for j in range(4) if (i, j) != (1, 1)], SHAPES)
    figures = overlay.boundary_figures(overlay.union_boundary(rows)).first()
    assert (round(figures.area, 6), round(figures.perimeter, 6)) == (1500.0, 200.0)
    assert overlay.boundary_figures(overlay.union_boundary(rows.limit(0))).first().area == 0.0


def test_repair(spark):
    bow = ring((0, 0), (4, 4), (4, 0), (0, 4))
    spike = ring((0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4))
    twice = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4))
    rows = spark.createDataFrame([(0, [bow]), (1, [spike]), (2, [square(0, 0, 8), square(1, 1, 6), square(2, 2, 2)]), (3, [ring((0, 0), (4, 0))]), (4, [twice]), (5, None), (6, [ring((0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0))])], SHAPES)
    got = {}
    for r in overlay.repair(rows, "k").withColumn("a", geo.area("rings")).collect():
        got.setdefault(r.k, []).append((r.part, len(r.rings), r.a))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 1, 4.0), (1, 1, 4.0)], 1: [(0, 1, 16.0)], 2: [(0, 2, 28.0), (1, 1, 4.0)], 6: [(0, 1, 16.0)]}
    sound = overlay.repair(rows.where("k = 6"), "k").first().rings[0]
    assert len(sound) == 5 and sound[0] == sound[-1]


def test_assembled_ways_equal_their_source(spark):
    rnd = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(12):
        rings = [corners(star(rnd, np.array([0.0, 0.0]), 30, 14)), corners(square(-1, -1, 2)), corners(square(100, 100, 8))][: 1 + k % 3]
        want[k] = sorted(round(abs(overlay._signed(r)), 3) for r in rings)
        ways = []
        for r in rings:
            cuts = np.sort(rnd.choice(len(r), 3, replace=False))
            closed = np.vstack([r, r])
            for a, b in zip(cuts, [*cuts[1:], cuts[0] + len(r)], strict=True):
                way = closed[a : b + 1]
                ways.append(way[::-1] if rnd.random() < 0.5 else way)
        ways.append(np.array([[500.0, 0.0], [510.0, 0.0]]))
        rows += [(k, ring(*ways[i])) for i in rnd.permutation(len(ways))]
    rows += [(50, ring((0, 0), (1, 0))), (51, None), (52, ring((0, 0), (3, 0), (3, 3), (0, 0)))]
    frame = spark.createDataFrame(rows, f"k int, points {geo.RING}")
    got = {}
    for r in overlay.assemble(frame, "k").collect():
        got.setdefault(r.k, []).append(r)
    for k, sizes in want.items():
        assert sorted(round(abs(overlay._signed(corners(x)[:-1])), 3) for r in got[k] for x in r.rings) == sizes
        assert {r.open_ways for r in got[k]} == {1}
        assert sorted(len(r.rings) for r in got[k]) == {0: [1], 1: [2], 2: [1, 2]}[k % 3]
    assert [(r.part, r.rings, r.open_ways) for r in got[50]] == [(None, None, 1)] and got[51][0].rings is None and got[52][0].open_ways == 0


def test_stored_boundaries(spark, tmp_path):
    line = lambda *p: [{"lat": float(y), "lon": float(x)} for x, y in p]
    answer = {"elements": [
        {"type": "relation", "id": 7, "tags": {"name": "Moda"}, "members": [{"type": "way", "role": "outer", "geometry": line((29, 41), (29.01, 41))}, {"type": "way", "role": "outer", "geometry": line((29, 41), (29, 41.01), (29.01, 41))}, {"type": "node", "role": "label"}]},
        {"type": "way", "id": 8, "tags": {"name": "Park"}, "geometry": line((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))},
        {"type": "relation", "id": 9, "tags": {}, "members": [{"type": "way", "role": "outer", "geometry": line((0, 0), (1, 1))}]},
        {"type": "node", "id": 10, "tags": {"name": "x"}},
    ]}
    (tmp_path / "kadikoy.json").write_text(json.dumps(answer))
    (tmp_path / "empty.json").write_text(json.dumps({"elements": []}))
    rows = readers.read_boundaries(spark, str(tmp_path / "*.json"))
    got = {(r.element, r.id): (r.neighbourhood_name, r.part, None if r.a is None else round(r.a, 6), r.open_ways) for r in rows.withColumn("a", geo.area("rings")).collect()}
    assert got == {("relation", 7): ("Moda", 0, 0.00005, 0), ("way", 8): ("Park", 0, 4.0, 0), ("relation", 9): (None, None, None, 1)}
    status = {r.place: (r.features, r.polygons, r.error) for r in readers.boundary_status(spark, str(tmp_path / "*.json"), rows).collect()}
    assert status == {"kadikoy": (3, 2, None), "empty": (0, 0, "no polygon")}


def test_points_meet_polygons_of_all_sizes(spark):
    """A district over many houses, points on corners, nearest polygons from near and far, against all pairs."""
    rnd = np.random.default_rng(12)
    shapes = [(0, 0, "district", [square(0, 0, 1000)]), (1, 1, "next", [square(1000, 0, 1000)])]
    shapes += [(k, k, f"house {k}", [square(*rnd.integers(0, 990, 2), int(rnd.integers(1, 10)))]) for k in range(2, 200)]
    polygons = spark.createDataFrame(shapes, f"poly_id int, poly_ord int, neighbourhood_name string, rings {geo.POLYGON}")
    assert spatial.with_levels(polygons, "rings").groupBy("poly_id").count().agg(F.max("count")).first()[0] <= 4
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate([*rnd.integers(-40, 1040, (150, 2)), (0, 0), (1000, 500), (2000, 1000), (-90000, 4), (1e7, -1e7), (1500, 2500)])]
    points = spark.createDataFrame(places, "k int, x double, y double")
    got = {(r.k, r.poly_id): r.tier for r in spatial.containing(points, polygons, "k").collect()}
    want = {}
    for k, x, y in places:
        for i, _, _, (r,) in shapes:
            a, b = (r[0]["x"], r[0]["y"]), (r[2]["x"], r[2]["y"])
            if a[0] <= x <= b[0] and a[1] <= y <= b[1]:
                want[k, i] = 1 if a[0] < x < b[0] and a[1] < y < b[1] else 2
    assert got == want
    houses = polygons.where("poly_id > 1")
    found = {r.k: r.neighbourhood for r in spatial.nearest_polygon(points, houses, "k", "neighbourhood_name").collect()}

    def away(x, y, r):
        a, b = (r[0]["x"], r[0]["y"]), (r[2]["x"], r[2]["y"])
        inside = min(x - a[0], b[0] - x, y - a[1], b[1] - y)
        return inside if inside > 0 else np.hypot(max(a[0] - x, 0, x - b[0]), max(a[1] - y, 0, y - b[1]))

    for k, x, y in places:
        least = min(away(x, y, r) for i, _, _, (r,) in shapes if i > 1)
        assert found[k] == f"house {next(i for i, _, _, (r,) in shapes if i > 1 and away(x, y, r) <= least + 1e-9)}"
    assert {r.neighbourhood for r in spatial.nearest_polygon(points.limit(3), polygons.limit(0), "k", "neighbourhood_name").collect()} == {None}
    plan = spatial.assign_neighbourhoods(points, polygons, "k")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_parts_of_crowded_cells_have_the_same_boundary(seed, monkeypatch):
    """Boxes, bow ties and rings with holes many deep: area as without cutting cells, and far fewer crossings where cover is deep."""
    rnd = np.random.default_rng(seed)
    shapes = []
    for k, (x, y, a, b) in enumerate(rnd.integers(0, 60, (90, 4)).tolist()):
        a, b = a // 3 + 4, b // 3 + 4
        ring = lambda *p: [{"x": float(u), "y": float(v)} for u, v in p]
        square = ring((x, y), (x + a, y), (x + a, y + b), (x, y + b))
        hole = ring((x + 1, y + 1), (x + 3, y + 1), (x + 3, y + 3), (x + 1, y + 3))
        shapes.append([[square], [square, hole], [ring((x, y), (x + a, y + b), (x + a, y), (x, y + b))], [ring((x, y), (x + a, y + 2), (x + 2, y + b))]][k % 4])
    edges = [overlay._edges(s, True) for s in shapes]
    box = (-1.0, -1.0, 101.0, 101.0)
    area = lambda g: float((g[:, 0] * g[:, 3] - g[:, 2] * g[:, 1]).sum() / 2)
    want = area(overlay.boundary(np.vstack(edges), "positive", box))
    monkeypatch.setattr(overlay, "_CROWD", 6)
    parts = list(overlay.parts_of(edges, box))
    got = sum(area(overlay.boundary(near, "positive", part, every, base)) for part, near, every, base in parts)
    assert len(parts) > 20 and abs(got - want) < 1e-3


def test_deep_cover_is_left_out():
    square = lambda x, y, s: np.array([(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)], float)
    rnd = np.random.default_rng(1)
    many = [square(-500, -500, 3000), *[square(x, y, 300) for x, y in rnd.uniform(0, 1000, (5000, 2))]]
    assert not list(overlay.parts_of(many, (0.0, 0.0, 1000.0, 1000.0)))


def test_boundaries_of_many_polygons_are_those_of_each():
    rnd = np.random.default_rng(3)
    polygons = [np.zeros((0, 4))]
    for k in range(400):
        corners = rnd.integers(0, 6, (int(rnd.integers(3, 9)), 2)).astype(float) if k % 2 else rnd.uniform(0, 6, (int(rnd.integers(3, 90 if k % 40 == 0 else 9)), 2))
        polygons.append(overlay._edges([[{"x": x, "y": y} for x, y in part] for part in np.array_split(corners, 1 + k % 2)], False))
    for e, got in zip(polygons, overlay.odd_boundaries(polygons), strict=True):
        want = overlay.boundary(e, "odd")
        assert got.shape == want.shape and np.abs(got - want).max(initial=0) < 1e-9


def test_repair_handles_polygons_together(spark, monkeypatch):
    """One by one they took about a millisecond each."""
    monkeypatch.setattr(overlay, "boundary", None)
    rows = spark.createDataFrame([(k, [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]) for k in range(50)] + [(99, None)], f"id long, rings {geo.POLYGON}")
    got = overlay.repair(rows, "id").collect()
    assert len(got) == 100 and {r.part for r in got} == {0, 1}
