"""Iterative graph operators on hand-made graphs, and their queries against DuckDB."""

import random

import duckdb
import pytest

from tests.test_queries import SF, flat
from pyspark.sql import functions as F

from tracelink.functions import stored
from tracelink.operators.exploration import filtered, neighbourhood, overview, scope
from tracelink.operators import graph as G
from tracelink.operators.graph import betweenness, communities, hop_paths, pagerank
from tracelink.plans import ORACLE_SQL, QUERIES


def graph(spark, pairs):
    edges = spark.createDataFrame(pairs, "source string, target string")
    return edges.selectExpr("source as id").union(edges.selectExpr("target")).distinct(), edges


@pytest.mark.parametrize("name", ["f9_personalised_pagerank", "f11_bounded_paths"])
def test_query_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in ("customer", "nation", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    assert flat(mine.select(*columns).collect()) == flat(db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) q").fetchall())


@pytest.mark.parametrize("name", ["f3_pagerank", "g14_priorities"])
def test_ranks_match_oracle_and_sources_are_read_once(spark, monkeypatch, name):
    wrote = []
    monkeypatch.setattr("tracelink.plans.graph.stored", lambda df, to: wrote.append(to) or stored(df, to))
    test_query_matches_oracle(spark, name)
    assert wrote == ["edges"]


def test_only_nodes_that_take_and_send_are_ranked_in_each_round(spark, monkeypatch):
    wrote = {}
    monkeypatch.setattr("tracelink.operators.graph.stored", lambda df, name: wrote.setdefault(name, []).append(stored(df, name)) or wrote[name][-1])
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("u", "a"), ("u", "e"), ("v", "b"), ("v", "b"), ("c", "e"), ("e2", "e2"), ("b", "f")]
    nodes, edges = graph(spark, [*pairs, ("alone", "f")])
    links = {p: pairs.count(p) / sum(q[0] == p[0] for q in pairs) for p in pairs} | {("alone", "f"): 1.0}
    ids = [r.id for r in nodes.collect()]
    for normalised, seeds in ((True, None), (False, None), (True, ["u", "c", "f"]), (False, ["u", "c"])):
        unit = 1 / len(ids) if normalised else 1.0
        restart = {i: 0.15 * unit * (seeds is None or i in seeds) for i in ids}
        want = dict(restart) if seeds or not normalised else dict.fromkeys(ids, unit)
        for _ in range(7):
            lost = sum(want[i] for i in ids if not any(a == i for a, _ in links)) / len(ids) if normalised else 0.0
            want = {i: restart[i] + 0.85 * (lost + sum(s * want[a] for (a, b), s in links.items() if b == i)) for i in ids}
        chosen = None if seeds is None else spark.createDataFrame([(i,) for i in seeds], "id string")
        assert dict(pagerank(nodes, edges, 7, 0.85, None, chosen, normalised).collect()) == pytest.approx(want, abs=1e-12)
        assert dict(pagerank(nodes, edges, 7, 0.85, 0.0, chosen, normalised).collect()) == pytest.approx(want, abs=1e-12)
    assert {r.id for r in wrote["core-nodes"][0].collect()} == {"a", "b", "c", "e2"}


def test_paths_of_betweenness_go_on_by_inner_steps_only(spark, monkeypatch):
    wrote = {}
    monkeypatch.setattr("tracelink.operators.graph.stored", lambda df, name: wrote.setdefault(name, []).append(stored(df, name)) or wrote[name][-1])
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("u", "b"), ("u", "d"), ("v", "c")])
    found = {k: round(v * 20, 9) for k, v in betweenness(nodes, edges).collect()}
    assert found == {"a": 0.0, "b": 3.0, "c": 3.0, "d": 0.0, "u": 0.0, "v": 0.0}
    assert {(r.source, r.target) for r in wrote["inner-steps"][0].collect()} == {("b", "c"), ("c", "d")} and len(wrote["nodes"]) == 1 and len(wrote["deltas"]) == 2


def test_betweenness_of_a_chain_and_a_diamond(spark):
    nodes, edges = graph(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    assert dict(betweenness(nodes, edges).collect()) == {"a": 0.0, "b": 0.5, "c": 0.0}
    nodes, edges = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert {k: round(v, 4) for k, v in betweenness(nodes, edges).collect()} == {"a": 0.0, "b": 0.0833, "c": 0.0833, "d": 0.0}


def test_communities_of_two_triangles(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")])
    found = dict(communities(nodes, edges).collect())
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_communities_settle_where_many_nodes_want_into_the_same_ones(spark):
    rng = random.Random(5)
    pairs = [(f"u{rng.randrange(400):03}", f"h{rng.randrange(30):02}") for _ in range(8000)]
    nodes, edges = graph(spark, pairs)
    found = dict(communities(nodes, edges, sweeps=45).collect())
    assert len(found) == nodes.count() and all(found[name] == name and name <= i for i, name in found.items())
    inside = sum(found[a] == found[b] for a, b in pairs) / len(pairs)
    weight = dict.fromkeys(found.values(), 0)
    for end in (e for pair in pairs for e in pair):
        weight[found[end]] += 1 / (2 * len(pairs))
    assert inside - sum(w * w for w in weight.values()) > 0.08


def test_weights_kept_from_sweep_to_sweep_give_the_same_communities(spark, monkeypatch):
    rng = random.Random(8)
    nodes, edges = graph(spark, [(f"u{rng.randrange(60):02}", f"h{rng.randrange(9)}") for _ in range(500)] + [("h1", "h1"), ("u01", "u02")])
    ways, weigh = [], G._weights
    monkeypatch.setattr(G, "_weights", lambda links, state, before, moved: ways.append(before is not None) or weigh(links, state, before, moved))
    monkeypatch.setattr(G, "FEW", -1)  # all links in every sweep, and no broadcast
    found = dict(communities(nodes, edges).collect())
    assert not any(ways)
    monkeypatch.setattr(G, "FEW", 100_000)
    monkeypatch.setattr(G, "MANY", 0)
    assert dict(communities(nodes, edges).collect()) == found and sum(ways) > 3


def test_groups_dealt_to_lines_give_communities_too(spark, monkeypatch):
    monkeypatch.setattr("tracelink.operators.graph.LINE", 1)
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")])
    assert dict(communities(nodes, edges).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_paths_take_the_least_ids_and_stop_at_the_depth(spark):
    _, edges = graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a")])
    seeds = spark.createDataFrame([("a",)], "id string")
    found = {r.id: (r.hops, r.path) for r in hop_paths(edges, seeds, 2).collect()}
    assert found["d"] == (2, ["a", "b", "d"]) and "e" not in found


def test_ranks_sum_to_one_and_empty_graphs_give_none(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")])
    assert sum(r.rank for r in pagerank(nodes, edges, 5).collect()) == pytest.approx(1)
    assert pagerank(nodes.limit(0), edges.limit(0)).count() == 0
    assert communities(nodes.limit(0), edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["j1_incremental_ingest", "d5_name_decision", "c8_span_fusion"])
def test_stream_and_entity_queries_match_oracle(spark, name):
    db = duckdb.connect()
    for t in ("customer", "nation", "orders", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    assert flat(mine.select(*columns).collect()) == flat(db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) q").fetchall())


def brute_betweenness(n, pairs):
    """Counts of shortest paths by breadth-first search from every node."""
    out, total = {v: [] for v in range(n)}, [0.0] * n
    for a, b in set(pairs):
        if a != b:
            out[a].append(b)
    for s in range(n):
        order, sigma, dist, delta = [s], {s: 1.0}, {s: 0}, {}
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        for v in reversed(order):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in out[v] if dist[w] == dist[v] + 1)
            total[v] += delta[v] if v != s else 0
    return [t / ((n - 1) * (n - 2)) for t in total]


def test_sampled_betweenness_keeps_its_bound(spark):
    rng = random.Random(11)
    n = 1500
    pairs = [(rng.randrange(n), rng.choice([0, 1, 2, rng.randrange(n)])) for _ in range(1200)] + [(rng.choice([0, 1, 2]), rng.randrange(n)) for _ in range(400)]
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string")
    want = brute_betweenness(n, pairs)
    exact = {int(r.id): r.betweenness for r in betweenness(nodes, edges).collect()}
    assert all(exact[i] == pytest.approx(want[i], abs=1e-9) for i in range(n))
    near = {int(r.id): r.betweenness for r in betweenness(nodes, edges, error=0.15, exact_below=100, first=128).collect()}
    assert max(abs(near[i] - want[i]) for i in range(n)) <= 0.15 and near != exact and max(want) > 0.05


def test_overview_and_scope_on_a_small_graph(spark):
    people = [(f"P{i}", "person") for i in range(60)]
    things = [(f"V{i:02}", "vehicle") for i in range(60)]
    nodes = spark.createDataFrame(people + things + [("X", None)], "id string, entity_type string")
    pairs = [(f"P{i}", f"V{i:02}") for i in range(60)] + [(f"P{i}", f"P{j}") for i in range(40) for j in range(i)]
    ends = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "id string, other string")
    got = {r.id: r for r in overview(nodes, ends).collect()}
    best = sorted((f"P{i}" for i in range(40)))[:28]
    assert len(got) == 40 and {i for i, r in got.items() if r.role == "person"} == set(best)
    assert {i for i, r in got.items() if r.role == "satellite"} == set(sorted(f"V{int(b[1:]):02}" for b in best)[:12])
    few = nodes.where("id IN ('P1', 'V01', 'X', 'V50')")
    assert {r.id: r.role for r in overview(nodes, ends, few).collect()} == {"P1": "person", "V01": "satellite", "X": "fill", "V50": "fill"}
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(scope(nodes, ends, few, path=("P9", "none"))) == {"P1", "V01", "X", "V50", "P9"}
    assert ids(scope(nodes, ends, nodes, selected="V50", hops=1)) == {"V50", "P50"} and ids(scope(nodes, ends, few, selected="P1", hops=3)) == {"P1", "V01"}
    assert len(ids(scope(nodes, ends, nodes, selected="P1", hops=3))) == 1 + 40 + 24
    assert ids(scope(nodes, ends, nodes, selected="none", community=few)) == {"P1", "V01", "X", "V50"} and len(ids(scope(nodes, ends, nodes, community=nodes))) == 40


def test_scope_joins_no_branch_of_its_ends_with_all_candidates(spark, monkeypatch):
    from tracelink.operators import exploration, graph

    plans = []
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    monkeypatch.setattr(exploration, "stored", graph.stored)
    nodes = spark.createDataFrame([(f"P{i}", "person") for i in range(9)], "id string, entity_type string")
    parts = [spark.createDataFrame([(f"P{i}", f"P{i + 1}"), (f"P{i + 1}", f"P{i}")], "id string, other string") for i in range(8)]
    ends = parts[0]
    for p in parts[1:]:
        ends = ends.unionAll(p)
    allowed = nodes.where("id <> 'P6'")
    assert {r.id for r in scope(nodes, ends, allowed, selected="P5", hops=3).collect()} == {"P2", "P3", "P4", "P5"}
    assert not [p for p in plans if "Union" in p and p.count("LeftSemi") > 1]


def test_neighbourhood_and_filters(spark):
    rows = [(1, "a", "b", "X", "2024-01-01"), (2, "b", "c", "X", None), (3, "c", "d", "Y", "2024-02-01"), (4, "d", "e", "X", "2024-03-01"), (5, "c", "a", "Y", "2024-01-05"), (6, "b", "b", "X", None)]
    edges = spark.createDataFrame(rows, "edge_id long, source string, target string, relationship string, seen string").withColumn("seen_at", F.col("seen").cast("timestamp")).drop("seen")
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    nodes, inner = neighbourhood(edges, seeds, 1)
    assert {r.id: r.hop for r in nodes.collect()} == {"a": 0, "b": 1, "c": 1} and {r.edge_id for r in inner.collect()} == {1, 2, 5, 6}
    assert {r.id for r in neighbourhood(edges, seeds, 0)[0].collect()} == {"a", "b", "c", "d"} and neighbourhood(edges, seeds, 99)[0].count() == 5
    ids = lambda d: {r.edge_id for r in d.collect()}
    assert ids(filtered(edges, ("Y", "Z"))) == {3, 5} and ids(filtered(edges, ("Z",))) == {1, 2, 3, 4, 5, 6}
    assert ids(filtered(edges, begin="2024-01-05", end="2024-02-01")) == {2, 3, 5, 6}
    with pytest.raises(ValueError):
        filtered(edges, begin="2024-02-01", end="2024-01-01")
