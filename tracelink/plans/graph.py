"""Queries of the iterative graph operators over the domain views. Oracles unroll a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.functions import stored
from tracelink.operators import bound, oracle
from tracelink.operators.catalog import OPERATORS, RISK
from tracelink.operators.exploration import filtered, neighbourhood, overview, scope
from tracelink.operators.graph import betweenness, communities, hop_expansion, hop_paths, neighbours, pagerank

ROUNDS, DAMPING, DEPTH = 20, 0.85, 6
#: Betweenness is exact below 2,000 nodes, else within this of the exact values (with a chance of 0.95 for all together).
ERROR = 0.02
SEEDS = ["P1", "P2", "P3"]
ALL_NODES, ALL_EDGES = "SELECT id FROM {nodes}", "SELECT source, target FROM {edges}"
PERSON_NODES, PERSON_EDGES = "SELECT person_id AS id FROM {persons}", OPERATORS["e11_person_projection"].replace("AS a, target AS b, relationship", "AS source, target AS target").replace("source, relationship FROM", "source FROM")
TALKS = "SELECT id AS source, other AS target FROM {ends} WHERE relationship IN ('CALLED', 'TRANSFERRED_MONEY')"
EITHER_WAY = "SELECT id AS source, other AS target FROM {ends}"


def _seeds(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _ids(ids: list[str]) -> str:
    return "(" + ", ".join(f"'{i}'" for i in ids) + ")"


def pagerank_sql(nodes: str, edges: str, normalised: bool, seeds: list[str] | None = None) -> str:
    """Common table expressions of ROUNDS rounds; the last is r{ROUNDS}(id, rank)."""
    restart = f"{1 - DAMPING} / (SELECT count(*) FROM v)" if normalised else str(1 - DAMPING)
    restart = f"CASE WHEN v.id IN {_ids(seeds)} THEN {restart} ELSE 0.0 END" if seeds else restart
    start = "1.0 / (SELECT count(*) FROM v)" if normalised else str(1 - DAMPING)
    parts = [f"v AS MATERIALIZED ({nodes})", f"w AS MATERIALIZED (SELECT source, target, count(*) AS w FROM ({edges}) e GROUP BY source, target)"]
    parts += ["l AS MATERIALIZED (SELECT w.source, w.target, CAST(w AS DOUBLE) / t AS share FROM w JOIN (SELECT source, sum(w) AS t FROM w GROUP BY source) o ON w.source = o.source)"]
    parts += ["s AS MATERIALIZED (SELECT DISTINCT source FROM w)", f"r0 AS MATERIALIZED (SELECT id, CAST({restart if seeds else start} AS DOUBLE) AS rank FROM v)"]
    for i in range(ROUNDS):
        lost = f"(SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT source FROM s)) / (SELECT count(*) FROM v)" if normalised else "0"
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, {restart} + {DAMPING} * (coalesce(f.flow, 0) + {lost}) AS rank FROM v LEFT JOIN (SELECT l.target, sum(share * rank) AS flow FROM l JOIN r{i} ON l.source = r{i}.id GROUP BY l.target) f ON v.id = f.target)")
    return "WITH " + ", ".join(parts) + " "


def paths_sql(edges: str, seeds: list[str], depth: int = DEPTH) -> str:
    """Common table expressions of breadth-first rounds; the last is h(seed, id, hops, path)."""
    first = " UNION ALL ".join(f"SELECT '{s}' AS seed, '{s}' AS id, 0 AS hops, ['{s}'] AS path" for s in seeds)
    parts = [f"st AS MATERIALIZED (SELECT DISTINCT source, target FROM ({edges}) e)", f"h0 AS MATERIALIZED ({first})", "a0 AS (SELECT * FROM h0)"]
    for i in range(1, depth + 1):
        found = f"SELECT seed, target AS id, {i} AS hops, list_append(min(path), target) AS path FROM h{i - 1} JOIN st ON h{i - 1}.id = st.source GROUP BY seed, target"
        parts.append(f"h{i} AS MATERIALIZED (SELECT f.* FROM ({found}) f WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.seed = f.seed AND a.id = f.id))")
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM h{i})")
    return "WITH " + ", ".join(parts) + f", h AS (SELECT seed, id, hops, array_to_string(path, ' ') AS path FROM a{depth}) "


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The edges, written once: the views on them, such as nodes and ends, read each source anew for every use."""
    return {"edges": stored(bound(spark, sf_dir, "SELECT * FROM {edges}"), "edges")}


def _rank(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    made = made or _views(spark, sf_dir)
    return pagerank(bound(spark, sf_dir, ALL_NODES, made), bound(spark, sf_dir, ALL_EDGES, made), ROUNDS, DAMPING, None)


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(bound(spark, sf_dir, PERSON_NODES), bound(spark, sf_dir, PERSON_EDGES), ROUNDS, DAMPING, None, _seeds(spark, SEEDS), normalised=False)


def _paths(spark: SparkSession, sf_dir: str, edges: str, seeds: list[str]) -> DataFrame:
    return hop_paths(bound(spark, sf_dir, edges), _seeds(spark, seeds), DEPTH).withColumn("path", F.concat_ws(" ", "path"))


def _risk(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    return bound(spark, sf_dir, f"SELECT person_id, {RISK} AS base FROM {{risk_inputs}}", made)


def f2_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact for small graphs, else within ERROR."""
    return _between(spark, sf_dir, _views(spark, sf_dir))


def _between(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
    out = betweenness(bound(spark, sf_dir, ALL_NODES, made), bound(spark, sf_dir, ALL_EDGES, made), ERROR)
    return out.select("id", F.round("betweenness", 6).alias("betweenness"))


def f3_pagerank(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    return _rank(spark, sf_dir, made).select("id", F.round("rank", 6).alias("pagerank"))


def f4_centrality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _views(spark, sf_dir)
    degree = bound(spark, sf_dir, OPERATORS["f1_degree_centrality"], made)
    return degree.join(_between(spark, sf_dir, made), "id").join(f3_pagerank(spark, sf_dir, made), "id")


def f5_key_persons(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    return f3_pagerank(spark, sf_dir, made).orderBy(F.desc("pagerank"), "id").limit(10)


def sized(found: DataFrame) -> DataFrame:
    """Communities with their size and a display id: 1 for the largest, of equal ones that of the least community first.

    Ranks come from a count by size, so no task sorts all communities but those of one size.
    """
    sizes = stored(found.groupBy("community").agg(F.count("*").alias("size")), "community-sizes")
    by_size = sizes.groupBy(F.col("size").alias("of")).count()
    larger = by_size.select(F.col("of").alias("size"), (F.sum("count").over(Window.orderBy(F.desc("of"))) - F.col("count")).alias("larger"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy("community"))
    shown = sizes.withColumn("place", rank).join(larger.hint("merge"), "size").select("community", "size", (F.col("larger") + F.col("place")).alias("display_id"))
    return found.join(shown.hint("merge"), "community").select("id", "community", "size", "display_id")


def f6_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(communities(bound(spark, sf_dir, PERSON_NODES), bound(spark, sf_dir, "SELECT source, target FROM {person_edges}")))


def f8_projected_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the person projection within a window of time, each pair of persons once for each of its relations."""
    edges = bound(spark, sf_dir, "SELECT source, target, seen_at, relationship FROM {person_edges}")
    return projected_communities(bound(spark, sf_dir, PERSON_NODES), edges)


def projected_communities(persons: DataFrame, edges: DataFrame, begin: str | None = None, end: str | None = None) -> DataFrame:
    """id, community, size, display_id on edges(source, target, relationship, seen_at) between begin and end (both included).

    Edges without a time count in every window; begin after end is an error.
    """
    if begin and end and begin > end:
        raise ValueError("begin after end")
    if begin:
        edges = edges.where(F.col("seen_at").isNull() | (F.col("seen_at") >= F.lit(begin).cast("timestamp")))
    if end:
        edges = edges.where(F.col("seen_at").isNull() | (F.col("seen_at") <= F.lit(end).cast("timestamp")))
    once = edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "relationship").distinct()
    return sized(communities(persons, once.select("source", "target")))


def f7_projected_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pagerank(bound(spark, sf_dir, PERSON_NODES), bound(spark, sf_dir, PERSON_EDGES), ROUNDS, DAMPING, None, normalised=False)
    return ranks.select("id", F.round("rank", 6).alias("pagerank"))


def f9_personalised_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("id", F.round("rank", 6).alias("pagerank"))


def f10_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, ALL_EDGES, SEEDS[:1])


def f11_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, TALKS, SEEDS)


def f14_evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each person and seed: the person itself, a path, or missing."""
    found = _paths(spark, sf_dir, TALKS, SEEDS).withColumnRenamed("id", "person_id")
    people = bound(spark, sf_dir, "SELECT person_id FROM {persons}").withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    kind = F.when(F.col("hops") == 0, "self").when(F.col("hops") > 0, "path").otherwise("missing")
    return people.join(found.hint("shuffle_hash"), ["seed", "person_id"], "left").select("seed", "person_id", kind.alias("kind"), "hops", "path")


def f15_hop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hop_expansion(bound(spark, sf_dir, "SELECT id, other FROM {ends}"), _seeds(spark, SEEDS[:1]))


def f12_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls and transfers among the nodes within two hops of P1 by them."""
    edges = filtered(bound(spark, sf_dir, "SELECT edge_id, source, target, relationship, seen_at FROM {edges}"), ("CALLED", "TRANSFERRED_MONEY", "NO_SUCH_TYPE"), "2024-01-03 00:00:00", "2024-01-25 00:00:00")
    edges = stored(edges, "neighbourhood-edges")
    return neighbourhood(edges, _seeds(spark, SEEDS[:1]))[1].select("edge_id", "source", "target", "relationship")


def f16_overview_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    return overview(bound(spark, sf_dir, "SELECT * FROM {nodes}", made), bound(spark, sf_dir, "SELECT id, other FROM {ends}", made))


def f17_exploration_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes of a selected node, of a community (those who live in one city) and of nothing chosen, a path shown in each."""
    made: dict[str, DataFrame] = {}
    nodes = stored(bound(spark, sf_dir, "SELECT * FROM {nodes}", made), "scope-nodes")
    ends = stored(neighbours(bound(spark, sf_dir, "SELECT id, other FROM {ends}", made)), "scope-ends")
    members = bound(spark, sf_dir, "SELECT person_id AS id FROM {persons} WHERE ord % 3 = 0", made)
    path = ("P7", "P8", "no such node")
    chosen = {"node": {"selected": "P1", "hops": 2}, "community": {"community": members}, "all": {}}
    parts = [scope(nodes, ends, nodes, path=path, **how).select(F.lit(name).alias("scope"), "id") for name, how in chosen.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def f22_hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, EITHER_WAY, SEEDS[:1]).select("id", "hops")


def g3_propagated_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base risk plus at most 10 points from closeness to the seeds; 100 at most."""
    near = _personal(spark, sf_dir).select(F.col("id").alias("person_id"), F.least(F.lit(10.0), F.round(F.col("rank") * 100, 2)).alias("propagated"))
    joined = _risk(spark, sf_dir).join(near.hint("shuffle_hash"), "person_id", "left").withColumn("propagated", F.coalesce("propagated", F.lit(0.0)))
    return joined.select("person_id", "base", "propagated", F.round(F.least(F.lit(100.0), F.col("base") + F.col("propagated")), 2).alias("risk_score"))


def g14_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key nodes with their base risk."""
    made = _views(spark, sf_dir)
    return f5_key_persons(spark, sf_dir, made).join(_risk(spark, sf_dir, made), F.col("id") == F.col("person_id"), "left").select("id", "pagerank", F.col("base").alias("risk_score"))


_GLOBAL = pagerank_sql(ALL_NODES, ALL_EDGES, True)
_PERSONAL = pagerank_sql(PERSON_NODES, PERSON_EDGES, False, SEEDS)
_LAST = f"SELECT id, round(rank, 6) AS pagerank FROM r{ROUNDS}"
_TOP = f"{_LAST} ORDER BY 2 DESC, 1 LIMIT 10"
_HOPS = [f"h{k} AS MATERIALIZED (SELECT id, {k} AS hop FROM (SELECT DISTINCT e.other AS id, d.d FROM h{k - 1} h JOIN {{ends}} e ON h.id = e.id JOIN deg d ON d.id = e.other WHERE e.other NOT IN ({' UNION ALL '.join(f'SELECT id FROM h{j}' for j in range(k))})) n ORDER BY d DESC, id LIMIT {most})" for k, most in ((1, 48), (2, 24), (3, 16))]
_EXPANSION = "WITH deg AS (SELECT id, count(DISTINCT other) AS d FROM {ends} WHERE id <> other GROUP BY id), h0 AS (SELECT 'P1' AS id, 0 AS hop), " + ", ".join(_HOPS)
_SEEDED = " UNION ALL ".join(f"SELECT '{s}' AS seed" for s in SEEDS)

_DEGREES = "SELECT n.id, n.entity_type, coalesce(d, 0) AS degree, CASE WHEN n.entity_type = 'person' THEN NULL ELSE o END AS owner FROM {nodes} n LEFT JOIN (SELECT e.id, count(DISTINCT e.other) AS d, min(CASE WHEN p.entity_type = 'person' THEN e.other END) AS o FROM {ends} e LEFT JOIN {nodes} p ON p.id = e.other WHERE e.id <> e.other GROUP BY e.id) x ON x.id = n.id"
_BEST = "ORDER BY degree DESC, id"


def _overview_sql(name: str, where: str) -> str:
    """Common table expressions; the last is {name}(id, place, role)."""
    return (
        f"{name}_c AS (SELECT * FROM measured WHERE {where}), {name}_p AS (SELECT id, degree, 1 AS part FROM {name}_c WHERE entity_type = 'person' {_BEST} LIMIT 28), "
        f"{name}_s AS (SELECT id, degree, 2 AS part FROM {name}_c WHERE owner IN (SELECT id FROM {name}_p) {_BEST} LIMIT 40), {name}_r AS (SELECT id, degree, 3 AS part FROM {name}_c {_BEST} LIMIT 200), "
        f"{name} AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY part, degree DESC, id) AS place, CASE part WHEN 1 THEN 'person' WHEN 2 THEN 'satellite' ELSE 'fill' END AS role FROM (SELECT id, min(part) AS part, max(degree) AS degree FROM (SELECT * FROM {name}_p UNION ALL SELECT * FROM {name}_s UNION ALL SELECT * FROM {name}_r) u GROUP BY id) g) w WHERE place <= CASE WHEN role = 'fill' THEN 30 ELSE 40 END)"
    )


_TWO_HOPS = _EXPANSION[: _EXPANSION.index(", h3 AS")]
_PATH = "SELECT '{0}' AS scope, id FROM {{nodes}} WHERE id IN ('P7', 'P8')"

_TEMPLATES = {
    "f12_neighbourhood": "WITH e AS (SELECT * FROM {edges} WHERE relationship IN ('CALLED', 'TRANSFERRED_MONEY') AND (seen_at IS NULL OR seen_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00')), b AS (SELECT source AS id, target AS other FROM e UNION SELECT target, source FROM e), "
    "h AS (SELECT 'P1' AS id UNION SELECT other FROM b WHERE id = 'P1' UNION SELECT c.other FROM b JOIN b c ON c.id = b.other WHERE b.id = 'P1') SELECT edge_id, source, target, relationship FROM e WHERE source IN (SELECT id FROM h) AND target IN (SELECT id FROM h)",
    "f16_overview_nodes": f"WITH measured AS ({_DEGREES}), {_overview_sql('o', 'true')} SELECT * FROM o",
    "f17_exploration_scope": f"{_TWO_HOPS}, measured AS ({_DEGREES}), members AS (SELECT id FROM measured WHERE id IN (SELECT person_id FROM {{persons}} WHERE ord % 3 = 0)), {_overview_sql('m', 'id IN (SELECT id FROM members)')}, {_overview_sql('o', 'true')} "
    "SELECT DISTINCT scope, id FROM (SELECT 'node' AS scope, id FROM h0 UNION ALL SELECT 'node', id FROM h1 UNION ALL SELECT 'node', id FROM h2 UNION ALL SELECT 'community', id FROM members WHERE (SELECT count(*) FROM members) <= 50 "
    f"UNION ALL SELECT 'community', id FROM m WHERE (SELECT count(*) FROM members) > 50 UNION ALL SELECT 'all', id FROM o UNION ALL {_PATH.format('node')} UNION ALL {_PATH.format('community')} UNION ALL {_PATH.format('all')}) s",
    "f3_pagerank": _GLOBAL + _LAST,
    "f5_key_persons": _GLOBAL + _TOP,
    "f7_projected_pagerank": pagerank_sql(PERSON_NODES, PERSON_EDGES, False) + _LAST,
    "f9_personalised_pagerank": _PERSONAL + _LAST,
    "f10_shortest_paths": paths_sql(ALL_EDGES, SEEDS[:1]) + "SELECT * FROM h",
    "f11_bounded_paths": paths_sql(TALKS, SEEDS) + "SELECT * FROM h",
    "f14_evidence_chains": paths_sql(TALKS, SEEDS) + f"SELECT p.seed, p.person_id, CASE WHEN hops = 0 THEN 'self' WHEN hops > 0 THEN 'path' ELSE 'missing' END AS kind, hops, path FROM (SELECT person_id, seed FROM {{persons}} CROSS JOIN ({_SEEDED}) s) p LEFT JOIN h ON h.seed = p.seed AND h.id = p.person_id",
    "f15_hop_expansion": _EXPANSION + " SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3",
    "f22_hop_distance": paths_sql(EITHER_WAY, SEEDS[:1]) + "SELECT id, hops FROM h",
    "g3_propagated_risk": _PERSONAL + f"SELECT person_id, base, propagated, round(least(100.0, base + propagated), 2) AS risk_score FROM (SELECT person_id, base, coalesce(least(10.0, round(rank * 100, 2)), 0.0) AS propagated FROM (SELECT person_id, {RISK} AS base FROM {{risk_inputs}}) a LEFT JOIN r{ROUNDS} ON person_id = id) z",
    "g14_priorities": _GLOBAL + f"SELECT id, pagerank, base AS risk_score FROM ({_TOP}) t LEFT JOIN (SELECT person_id, {RISK} AS base FROM {{risk_inputs}}) a ON id = person_id",
}

QUERIES = {f.__name__: f for f in (f2_betweenness, f3_pagerank, f4_centrality_table, f5_key_persons, f6_communities, f8_projected_louvain, f7_projected_pagerank, f9_personalised_pagerank, f10_shortest_paths, f11_bounded_paths, f14_evidence_chains, f12_neighbourhood, f15_hop_expansion, f16_overview_nodes, f17_exploration_scope, f22_hop_distance, g3_propagated_risk, g14_priorities)}
ORACLE_SQL = {name: oracle(t) for name, t in _TEMPLATES.items()}
