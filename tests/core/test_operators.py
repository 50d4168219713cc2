"""Operators on small frames, the decision tables of the rules, and brute force for searches."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.functions import text
from geoloom.operators import analytics, interchange, location, names, network, population, registry, rules, signatures, spatial

# What a rule takes: all pairs of a strict set, a wildcard of one, a query pair, a name where the tags say nothing against it.
POSITIVE = [
    ("building_church", {"building": "church", "denomination": "orthodox"}),
    ("building_mosque", {"religion": "muslim", "amenity": "place_of_worship"}),
    ("clinic", {"amenity": "clinic", "operator": "Poliklinik Deniz"}),
    ("hospital", {"healthcare": "hospital", "beds": "40"}),
    ("pharmacy", {"amenity": "pharmacy", "shop": "chemist"}),
    ("building_school", {"building": "school", "levels": "3"}),
    ("building_residential", {"building": "residential", "addr:street": "Nar Sokak"}),
    ("park", {"leisure": "park", "access": "yes"}),
    ("assembly_point", {"emergency": "assembly_point", "leisure": "park"}),
]
# What it leaves: another faith's building, a neighbouring kind of the same group, pairs under the wrong key, nothing at all.
NEGATIVE = [
    ("building_mosque", {"building": "synagogue", "religion": "jewish"}),
    ("building_church", {"religion": "buddhist", "amenity": "place_of_worship"}),
    ("hospital", {"amenity": "veterinary"}),
    ("clinic", {"shop": "optician"}),
    ("pharmacy", {"amenity": "dentist"}),
    ("building_school", {"amenity": "kindergarten", "building": "kindergarten"}),
    ("building_university", {"building": "warehouse"}),
    ("building_residential", {"residential": "building"}),
    ("park", {"park": "leisure"}),
    ("assembly_point", {"highway": "bus_stop"}),
    ("building_residential", {}),
]


@pytest.mark.parametrize("sample,wanted", [(POSITIVE, True), (NEGATIVE, False)])
def test_rule_decisions(spark, sample, wanted):
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(sample)], "k int, tags map<string,string>")
    for k, (code, tags) in enumerate(sample):
        got = rows.where(F.col("k") == k).select(rules.verdicts(rules.normalized_tags("tags"), [registry.BY_CODE[code]])[0].alias("v")).first().v
        assert got.matched is wanted, (code, tags, got)


def test_confidence_of_rules(spark):
    cases = [("building_residential", {"building": "residential"}, "high"), ("building_residential", {"building": "house"}, "high"), ("park", {"leisure": "park"}, "medium"), ("assembly_point", {"leisure": "park"}, "low"), ("hospital", {"amenity": "hospital", "healthcare": "hospital"}, "high")]
    for code, tags, label in cases:
        row = spark.createDataFrame([(tags,)], "tags map<string,string>").select(rules.best(rules.normalized_tags("tags"), [registry.BY_CODE[code]]).alias("v")).first().v
        assert row.confidence == label, (code, tags, row)


def test_yes_buildings_are_judged_again(spark):
    rows = spark.createDataFrame([(1, {"building": "yes", "amenity": "hospital"}), (2, {"building": "yes"}), (3, {"building": "house"}), (4, None)], "id int, tags map<string,string>")
    got = {r.id: r for r in rules.classify(rows, [registry.BY_CODE["building_house"]], registry.RULES).collect()}
    assert got[1].rule_code in ("building_hospital", "hospital") and got[1].reason.startswith("building_yes_mapped:")
    assert got[2].rule_code == rules.UNRESOLVED_YES and not got[2].matched
    assert got[3].rule_code == "building_house" and got[3].category_group == "buildings"
    assert got[4].rule_code is None and got[4].confidence == "none"


def test_rules_are_validated():
    with pytest.raises(ValueError):
        rules.Rule("x", "g", "k", query={"building": "x"})
    assert len(registry.BY_CODE) == len(registry.RULES)


def test_names_and_cells(spark):
    row = spark.createDataFrame([("  Şifa  ECZANESİ (Merkez)", "Caferağa Mahallesi", " 12,5 ", "nan")], "a string, b string, c string, d string")
    got = row.select(text.normalize_name("a").alias("a"), text.normalize_neighbourhood("b").alias("b"), text.coerce_capacity("c").alias("c"), text.normalize_value("d").alias("d"), text.is_filled("d").alias("e"), text.slug("a").alias("f")).first()
    assert tuple(got) == ("sifa eczanesi merkez", "caferaga", 12.5, "", False, "sifa_eczanesi_merkez")


def test_patterns(spark):
    rows = spark.createDataFrame([(1, "Atatürk İlkokulu"), (2, "Kurşunoğlu"), (3, "Anka Tıp Merkezi"), (4, "Maçka Parkı")], "k long, name string")
    got = {r.k: r.rule_code for r in names.detect_category(rows, "name", names.pattern_table(spark, registry.name_patterns()), registry.UMBRELLAS, "k").collect()}
    assert got == {1: "primary_school", 2: None, 3: "clinic", 4: "park"}


def test_set_ratio():
    assert names.set_ratio("anka", "anka sanat") == 100
    assert names.set_ratio("", "x") == 0
    assert names.set_ratio("a b", "c d") < 100
    assert names.indel_ratio("abc", "abc") == 100 and names.indel_ratio("abc", "xyz") == 0


def test_match_names(spark):
    pool = spark.createDataFrame([(1, "Şifa Eczanesi"), (2, "Merkez Eczanesi"), (3, "Yeni Merkez Eczanesi")], "id long, name string")
    cand = names.candidates(pool, "id", F.array("name"), [*text.GENERIC_STOPWORDS, "eczanesi", "eczane"])
    asked = spark.createDataFrame([(1, "sifa"), (2, "ŞİFA ECZANE"), (3, "sifa"), (4, ""), (5, "Bulunmaz"), (6, None)], "row long, name string")
    got = {r.row: r for r in names.match_names(asked, "name", "row", cand, rule_stopwords=["eczanesi", "eczane"]).collect()}
    assert [got[k].status for k in range(1, 7)] == ["Matched", "Matched", "Matched", "Empty", "Not found", "Empty"]
    assert got[2].cand_id == 1


SQUARES = [(0, 0, "a", [[[(0, 0), (10, 0), (10, 10), (0, 10)]]]), (1, 1, "b", [[[(10, 0), (20, 0), (20, 10), (10, 10)]]]), (2, 2, "hole", [[[(0, 20), (10, 20), (10, 30), (0, 30)], [(2, 22), (8, 22), (8, 28), (2, 28)]]])]


@pytest.fixture(scope="module")
def squares(spark):
    return spark.createDataFrame([(i, o, n, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p[0]]) for i, o, n, p in SQUARES], f"poly_id int, poly_ord int, neighbourhood_name string, rings {geo.POLYGON}")


def test_neighbourhood_cascade(spark, squares):
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 25.0, 5.0), (4, 5.0, 25.0), (5, 1.0, 25.0)], "id int, x double, y double")
    got = {r.id: (r.neighbourhood, r.boundary_status) for r in spatial.assign_neighbourhoods(points, squares, "id").collect()}
    assert got == {1: ("a", "inside"), 2: ("a", "on boundary"), 3: ("b", "outside"), 4: ("hole", "outside"), 5: ("hole", "inside")}


def test_area_tiers(spark, squares):
    inner = [[{"x": 2.0, "y": 2.0}, {"x": 6.0, "y": 2.0}, {"x": 6.0, "y": 6.0}, {"x": 2.0, "y": 6.0}]]
    overlay = squares.select("poly_id", "poly_ord", "rings").unionByName(spark.createDataFrame([(9, 9, inner)], f"poly_id int, poly_ord int, rings {geo.POLYGON}"))
    rows = spark.createDataFrame([(1, None, 3.0, 3.0, "200"), (2, None, 100.0, 100.0, "200"), (3, None, 100.0, 100.0, None), (4, inner, None, None, "5"), (5, None, 9.0, 9.0, None)], f"id int, rings {geo.POLYGON}, x double, y double, capacity string")
    got = {r.id: (r.footprint_m2, r.area_source) for r in spatial.add_footprint(rows, "id", overlay=overlay).collect()}
    assert got == {1: (16.0, "polygon_overlay"), 2: (300.0, "capacity_derived"), 3: (None, ""), 4: (16.0, "measured"), 5: (100.0, "polygon_overlay")}


def test_geometry_repairs_and_points(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 3.0}, {"x": 0.0, "y": 0.0}]
    row = spark.createDataFrame([([ring],), ([ring[:2]],)], f"rings {geo.POLYGON}").withColumn("rings", geo.clean_polygon("rings"))
    got = row.select(geo.area("rings").alias("a"), geo.interior_point("rings").alias("p"), geo.wkt("rings").alias("w")).collect()
    assert got[0].a == 6.0 and 0 < got[0].p.y < 3 and got[0].w.startswith("POLYGON ((0.0 0.0, 4.0 0.0") and got[1].a is None
    inside = row.where("rings is not null").withColumn("p", geo.interior_point("rings")).select(geo.inside(F.col("p.x"), F.col("p.y"), F.col("rings"))).first()[0]
    assert inside


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(41.0, 29.0), (40.6, 27.0), (0.0, 27.0)], "lat double, lon double").withColumn("u", geo.to_utm("lat", "lon"))
    got = rows.withColumn("b", geo.to_wgs84(F.col("u.x"), F.col("u.y"))).collect()
    assert all(abs(r.b.lat - r.lat) < 1e-9 and abs(r.b.lon - r.lon) < 1e-9 for r in got)
    assert abs(got[1].u.x - 500000) < 1e-6 and abs(got[2].u.y) < 1e-6
    assert abs(got[0].u.x - 668207.885) < 0.01 and abs(got[0].u.y - 4540683.529) < 0.01


def test_hull():
    assert set(geo.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}
    assert geo.hull([(0, 0), (1, 1), (2, 2)]) == []


def test_weighted_percentile(spark):
    inf, nan = float("inf"), float("nan")
    cases = [([(1, 1), (5, 1), (10, 1), (50, 1), (100, 1)], 100.0), ([(1, 1), (2, 1), (90, 98)], 90.0), ([(1, 1000), (500, 1)], 1.0), ([(1, 1), (inf, 9)], inf), ([(3, 1), (nan, 50)], 3.0), ([(3, 0)], None)]
    for rows, want in cases:
        frame = spark.createDataFrame([(float(v), float(w)) for v, w in rows], "v double, w double")
        assert analytics.weighted_percentile(frame, "v", "w", 0.95).first()[0] == want
        if want is not None:
            assert location.weighted_quantile(np.array([float(v) for v, _ in rows]), np.array([float(w) for _, w in rows]), 0.95) == want


def test_population(spark):
    table = spark.createDataFrame([(0, "Moda", 100.0), (1, "caferaga mah.", 200.0), (2, "Moda", 300.0), (3, "Boş", 0.0), (4, "Fenerbahce Kalamis", 50.0)], "o long, name string, pop double")
    b = spark.createDataFrame([(1, "Moda", 2.0), (2, "Moda", 4.0), (3, "Caferağa Mahallesi", 5.0), (4, "Yok", 7.0), (5, "Fenerbahçe Kalamış Adası", 1.0)], "building_idx long, neighbourhood string, weight double")
    totals = population.lookup_population(b, table, "name", "pop", "o", fuzzy=80.0)
    assert {r.neighbourhood: (r.population, r.match) for r in totals.collect()} == {"Moda": (300.0, "exact"), "Caferağa Mahallesi": (200.0, "normalized"), "Yok": (None, "unmatched"), "Fenerbahçe Kalamış Adası": (50.0, "fuzzy")}
    got = {r.building_idx: (r.weight, r.pop_source) for r in population.calibrate(b, totals).collect()}
    assert got == {1: (100.0, "official_exact"), 2: (200.0, "official_exact"), 3: (200.0, "official_normalized"), 4: (7.0, "estimated"), 5: (50.0, "official_fuzzy")}
    even = {r.building_idx: r.weight for r in population.uniform_weights(b, totals).collect()}
    assert even == {1: 150.0, 2: 150.0, 3: 200.0, 4: None, 5: 50.0}


def test_streets(spark):
    edges = spark.createDataFrame([(1, 2, 100.0, True), (2, 3, 100.0, True), (1, 2, 300.0, True)], "src long, dst long, length_m double, oneway boolean")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 900.0, 0.0)], "id long, x double, y double")
    at = spark.createDataFrame([(0, 1)], "area_idx long, node long")
    walk = {r.node: r.metres for r in network.street_distances(at, edges, "walk").collect()}
    assert walk == {1: 0.0, 2: 100.0, 3: 200.0}
    assert {r.node for r in network.street_distances(at, edges, "drive").collect()} == {1}
    assert {r.node for r in network.street_distances(at, edges, "walk", cutoff=100.0).collect()} == {1, 2}
    far = {r.node: r.metres for r in network.frontier_distances(at, network.street_edges(edges, "walk"), checkpoint=False).collect()}
    assert far == walk
    health = network.graph_health(nodes, edges).first()
    assert (health.nodes, health.components, health.largest) == (4, 2, 3)
    near = {r.k: r.node for r in network.nearest_node(spark.createDataFrame([(1, 95.0, 3.0), (2, 5000.0, 0.0), (3, 50.0, 0.0)], "k int, x double, y double"), nodes, "k", 50.0).collect()}
    assert near == {1: 2, 2: 4, 3: 1}


def random_problem(seed, n=25, m=7, **how):
    rnd = np.random.default_rng(seed)
    return location.Problem(rnd.uniform(2, 15, (n, m)), rnd.uniform(1, 9, n), **how)


@pytest.mark.parametrize("objective", location.MODES)
def test_heuristic_is_no_better_than_exact(objective):
    for seed in range(5):
        p = random_problem(seed, objective=objective)
        exact, rough = p.exact(3), p.heuristic(3, restarts=3)
        assert exact.cost <= rough.cost + 1e-9
        assert exact.cost == min(p.cost(s) for s in itertools.combinations(range(7), 3))
        assert rough.cost <= p.heuristic(3).cost + 1e-9
        assert p.heuristic(3, restarts=3).open_areas == rough.open_areas


def test_capacity_is_never_exceeded():
    p = random_problem(1)
    p.capacity = np.full(7, 30.0)
    area, reason = p.assign([0, 1, 2])
    for a in (0, 1, 2):
        assert p.weights[area == a].sum() <= 30
    assert set(reason[area < 0]) == {2} and (reason[area >= 0] == 0).all()
    assert p.feasibility(3) and "capacities" in p.feasibility(3)[0]


def test_outlier_objectives_differ():
    minutes = np.array([[3.0, 9.0]] * 30 + [[60.0, 20.0]])
    p95, worst = (location.solve(location.Problem(minutes, np.ones(31), objective=o), 1).open_areas for o in ("min_p95", "min_max"))
    assert p95 == [0] and worst == [1]


def test_solver_errors():
    with pytest.raises(ValueError):
        location.Problem(np.zeros((0, 3)), np.zeros(0))
    with pytest.raises(ValueError):
        location.Problem(np.ones((2, 2)), np.ones(2), objective="best")
    with pytest.raises(ValueError):
        location.solve(random_problem(0), 0)


def brute_assignment(minutes, weights, capacity, p, objective="min_sum"):
    """Cost of the best subset and assignment, all tried."""
    best = np.inf
    for s in itertools.combinations(range(minutes.shape[1]), p):
        for pick in itertools.product(s, repeat=len(minutes)):
            if all(weights[[i for i, k in enumerate(pick) if k == a]].sum() <= capacity[a] for a in s):
                t = [minutes[i, k] for i, k in enumerate(pick)]
                best = min(best, float(np.dot(weights, t)) if objective == "min_sum" else max(t))
    return best


def test_exact_solver_keeps_capacities():
    prefer = location.Problem(np.array([[1.0, 9.0], [1.0, 9.0]]), np.array([10.0, 10.0]), np.array([10.0, 10.0]))
    got = location.solve(prefer, 2, method="exact")
    assert (got.status, got.cost, sorted(got.assignment)) == ("optimal", 100.0, [0, 1])
    whole = location.Problem(np.ones((3, 2)), np.full(3, 10.0), np.array([15.0, 15.0]))
    assert whole.exact(2).status == "infeasible" and location.solve(whole, 2, method="exact").warnings
    rnd = np.random.default_rng(3)
    for k in range(25):
        minutes, weights = rnd.integers(1, 30, (6, 4)).astype(float), rnd.integers(1, 9, 6).astype(float)
        capacity = rnd.integers(6, 25, 4).astype(float)
        objective = ("min_sum", "min_max")[k % 2]
        want, got = brute_assignment(minutes, weights, capacity, 2, objective), location.Problem(minutes, weights, capacity, objective).exact(2)
        assert got.cost == want and got.status == ("optimal" if np.isfinite(want) else "infeasible")
        if np.isfinite(want):
            assert set(got.assignment) <= set(got.open_areas) and all(weights[got.assignment == a].sum() <= capacity[a] for a in got.open_areas)
    few = location.Problem(minutes, weights, np.full(4, 20.0)).exact(2, most_steps=3)
    assert few is None or few.status == "feasible"


def test_nearest_planar_equals_all_pairs(spark):
    rnd = np.random.default_rng(9)
    places = lambda n, name, spread: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.integers(0, spread, (n, 2)))], f"{name} int, x double, y double")
    for n, m, spread in ((300, 25, 4000), (50, 1, 10), (40, 6, 3), (30, 8, 200_000)):
        b, a = places(n, "building_idx", spread), places(m, "area_idx", max(2, spread // 3))
        want = sorted(map(tuple, network.nearest_area(network.planar_od(b, a)).collect()))
        assert sorted(map(tuple, network.nearest_planar(b, a).collect())) == want
    assert network.nearest_node(b.limit(1), a.limit(0).withColumnRenamed("area_idx", "id"), "building_idx", 1.0).first().node is None


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "k double, v long")
    total, want = 0, []
    for k, v in sorted(map(tuple, rows.collect())):
        total += v
        want.append((k, v, total))
    assert sorted(map(tuple, analytics.running_sum(rows, "k", "v", "s").collect())) == want


def test_components_of_long_ways(spark):
    from geoloom.plans.fixtures import ensure_checkpoints

    ensure_checkpoints(spark)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 101 + i) for i in range(0, 20, 2)] + [(7, 3), (200, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 120), 200, 300]], "id long")
    got = dict(map(tuple, network.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 + i // 2 * 2 for i in range(20)) and got[200] == 200 and got[300] == 300


def test_parallel_oneway_streets(spark):
    """A oneway street beside a two-way one of the same ends isn't opened against its direction."""
    edges = spark.createDataFrame([(1, 2, 50.0, True), (1, 2, 100.0, False), (3, 2, 10.0, True)], "src long, dst long, length_m double, oneway boolean")
    assert sorted(map(tuple, network.street_edges(edges, "drive").collect())) == [(1, 2, 100.0), (2, 1, 50.0), (2, 3, 10.0)]
    assert sorted(map(tuple, network.street_edges(edges, "walk").collect())) == [(1, 2, 50.0), (2, 1, 50.0), (2, 3, 10.0), (3, 2, 10.0)]


def test_reports_tell_the_solved_assignment():
    rnd = np.random.default_rng(8)
    for _ in range(60):
        minutes, weights = rnd.integers(1, 30, (6, 4)).astype(float), rnd.integers(1, 9, 6).astype(float)
        problem = location.Problem(minutes, weights, rnd.integers(8, 25, 4).astype(float))
        for row in location.sensitivity(problem, [2, 3], method="exact"):
            s = location.solve(problem, row["p"], method="exact")
            if s.assignment is None:
                continue
            t = minutes[np.arange(6), s.assignment]
            assert float((t * weights).sum()) == s.cost and row["unassigned"] == 0 and s.gap == 0.0
            assert (row["cost"], row["mean"], row["max"]) == (round(s.cost, 2), round(t.mean(), 2), t.max())
        for row in location.density_sweep(problem, rnd.integers(5, 40, 4).astype(float), 3, densities=(1.0,), least=5.0, method="exact"):
            assert row["assigned"] + row["full"] == 6


def long_table(spark, minutes):
    n, m = minutes.shape
    rows = [(i, 10 + a, float(minutes[i, a])) for i in range(n) for a in range(m) if np.isfinite(minutes[i, a])]
    return spark.createDataFrame(rows, "building_idx int, area_idx int, minutes float")


def test_interchange_equals_swaps_on_the_matrix(spark):
    rnd = np.random.default_rng(4)
    for seed, p in ((1, 3), (2, 4)):
        minutes = rnd.uniform(1, 60, (60, 9)).astype(np.float32).astype(float)
        minutes[rnd.random(minutes.shape) < 0.2] = np.inf
        minutes[:2] = np.inf
        weights = rnd.integers(0, 9, 60).astype(float)
        demand = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "building_idx int, weight double")
        od, problem = long_table(spark, minutes), location.Problem(minutes, weights)
        rough = problem.heuristic(p)
        got = interchange.locate(od, demand, p, first=True, bound_rounds=8)
        assert got.open_areas == [a + 10 for a in rough.open_areas] and got.converged
        assert np.allclose(got.trajectory, rough.trajectory)
        least = min(problem.cost(s) for s in itertools.combinations(range(9), p))
        assert got.bound <= least + 1e-6 and 0 <= got.gap < 0.5
        steep = interchange.locate(od, demand, p, bound_rounds=0, restarts=2)
        assert steep.cost >= least - 1e-6 and abs(problem.cost([a - 10 for a in steep.open_areas]) - steep.cost) < 1e-6
        sums = interchange.price(interchange.ways(od, demand), [10, 13, 15], 120.0)
        now = problem.cost([0, 3, 5])
        for r in interchange.savings(sums, [10, 13, 15]).collect():
            after = problem.cost([a for a in (0, 3, 5) if a != r.r - 10] + [r.a - 10])
            assert abs(now - after - r.saves) < 1e-6


def test_interchange_of_few_areas_and_none(spark):
    demand = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "building_idx int, weight double")
    od = spark.createDataFrame([(0, 5, 4.0), (2, 5, 6.0), (2, 6, 2.0)], "building_idx int, area_idx int, minutes float")
    got = interchange.locate(od, demand, 7, limit=10.0)
    assert (got.open_areas, got.cost) == ([5, 6], 4.0 + 6.0) and got.bound <= got.cost
    assert interchange.locate(od, demand, 1, limit=3.0).open_areas == [6]
    with pytest.raises(ValueError):
        interchange.locate(od.limit(0), demand, 1)
    with pytest.raises(ValueError):
        interchange.locate(od, demand, 0)


def test_fingerprints(spark):
    rows = [(1, "a", None, [1, 2]), (2, "", 3.5, []), (2, "", 3.5, []), (None, None, 1.0, None)]
    make = lambda r, n: spark.createDataFrame(r, "k int, s string, d double, l array<int>").repartition(n)
    of = lambda r, n=1: tuple(signatures.fingerprint(make(r, n)).first())
    base = of(rows)
    assert base == of(rows[::-1], 3) and base[0] == 4
    assert len({base, of(rows[:3]), of(rows[:2] + rows[3:]), of([(1, "a", None, [2, 1]), *rows[1:]]), of([(1, "a", 0.0, [1, 2]), *rows[1:]]), of([*rows[:3], (None, "", 1.0, None)])}) == 6
    assert of([(1, "x|1:y", None, None)]) != of([(1, "x", None, None)])
    assert of([]) == (0, "0", 0)
    got = dict(map(tuple, signatures.changes(make(rows, 2), make([(2, "", 3.5, []), (2, "", 3.5, []), (None, None, 2.0, None), (9, "z", None, None)], 3), "k").collect()))
    assert got == {1: "removed", 2: "same", None: "changed", 9: "added"}
    assert signatures.settings_diff({"p": 3, "limit": None, "x": 0.5, "same": [1]}, {"p": 4, "x": 0.50001, "same": [1], "new": "a"}) == [("new", "-", "a"), ("p", "3", "4")]


def test_small_audits(spark):
    rows = spark.createDataFrame([(1, " School ", 2.0), (2, None, None), (3, "yes", 5.0), (4, "office", None)], "k int, b string, v double")
    assert [r.k for r in analytics.select_values(rows, {"b": ["yes", None], "v": []}).orderBy("k").collect()] == [2, 3]
    assert tuple(analytics.count_values(rows, "b", population.NON_RESIDENTIAL).first()) == (2, 4)
    assert [r.k for r in analytics.audit_order(rows, "v", "k").collect()] == [3, 1, 2, 4]
    assert [r.k for r in analytics.preview(rows, ["k"], 2).collect()] == [1, 2]
    assert tuple(analytics.sample_names(rows, "b", 2).first()) == (3, [" School ", "office"])
    assert tuple(analytics.sample_names(rows.limit(0), "b").first()) == (0, [])
    opened, closed = analytics.split_open(rows, rows.where("k > 2"), "k")
    assert sorted(r.k for r in opened.collect()) == [3, 4] and sorted(r.k for r in closed.collect()) == [1, 2]


def test_common_subsequences_by_bits():
    rnd = np.random.default_rng(1)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice(list("abcdü "), rnd.integers(0, 150))) for _ in range(2))
        assert names._lcs(a, b) == table(a, b)
