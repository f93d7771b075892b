"""Which part of a graph to show: an overview of a bounded number of nodes, and the scope of an exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import stored
from tracelink.operators.graph import hop_expansion, neighbours

# People of an overview, its nodes, the nodes it is filled up to, members over which a community is shown by an overview,
# and all nodes of a neighbourhood.
PEOPLE, TARGET, FILL, SHOWN, NEIGHBOURHOOD = 28, 40, 30, 50, 90


def _measured(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes(id, entity_type) with degree (different neighbours) and owner (the least person next to a node that is none)."""
    pairs = neighbours(ends)
    people = nodes.where("entity_type = 'person'").select(F.col("id").alias("other"), F.lit(True).alias("is_person"))
    near = pairs.join(people.hint("merge"), "other", "left")
    told = near.groupBy("id").agg(F.count("*").alias("degree"), F.min(F.when(F.col("is_person"), F.col("other"))).alias("owner"))
    owner = F.when(F.coalesce(F.col("entity_type") != "person", F.lit(True)), F.col("owner"))
    return nodes.select("id", "entity_type").join(told.hint("merge"), "id", "left").select("id", "entity_type", F.coalesce("degree", F.lit(0)).alias("degree"), owner.alias("owner"))


def overview(nodes: DataFrame, ends: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """id, place (from 1), role: at most TARGET nodes. The PEOPLE of greatest degree, then nodes that belong to them while there is
    room, then, if these are fewer than FILL, any others; always by degree, ties to the lesser id.

    nodes(id, entity_type), ends(id, other) with each edge both ways, candidates(id) that may be shown (all if not given). Each
    part is cut to its own limit before the parts meet, so the last window holds some hundred rows.
    """
    known = stored(_measured(nodes, ends), "nodes-measured")
    open_ = known if candidates is None else known.join(candidates.select("id").distinct().hint("merge"), "id", "left_semi")
    best = [F.desc("degree"), F.asc("id")]
    people = stored(open_.where("entity_type = 'person'").orderBy(*best).limit(PEOPLE).select("id", "degree"), "overview-people")
    owned = open_.join(people.select(F.col("id").alias("owner")).hint("merge"), "owner", "left_semi")
    satellites = owned.orderBy(*best).limit(TARGET).select("id", "degree")
    rest = open_.orderBy(*best).limit(2 * TARGET + FILL).select("id", "degree")
    ranked = people.withColumn("part", F.lit(1)).unionAll(satellites.withColumn("part", F.lit(2))).unionAll(rest.withColumn("part", F.lit(3)))
    first = ranked.groupBy("id").agg(F.min("part").alias("part"), F.max("degree").alias("degree"))
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("part", *best)))
    roles = F.when(F.col("part") == 1, "person").when(F.col("part") == 2, "satellite").otherwise("fill")
    room = F.when(F.col("part") == 3, FILL).otherwise(TARGET)
    return placed.where(F.col("place") <= room).select("id", "place", roles.alias("role"))


def scope(nodes: DataFrame, ends: DataFrame, candidates: DataFrame, selected: str | None = None, hops: int = 1, path: tuple[str, ...] = (), community: DataFrame | None = None) -> DataFrame:
    """id: the nodes to show. A selected node that exists with its neighbourhood of 1 to 3 hops among the candidates; else the
    community's candidates, all of them if they are few and else an overview of them; else an overview of the candidates. The nodes of
    a path, and the selected one, are always shown if they exist."""
    spark = nodes.sparkSession
    one = nodes.where(F.col("id") == F.lit(selected)).select("id") if selected is not None else nodes.limit(0).select("id")
    allowed = candidates.select("id").distinct()
    if not one.isEmpty():
        may = stored(allowed.unionAll(one).distinct(), "scope-candidates")
        most = (48, 24, 16)[: max(1, min(3, hops))]
        shown = hop_expansion(ends, one, most, NEIGHBOURHOOD, may).select("id")
    elif community is not None and not community.isEmpty():
        members = stored(community.select("id").distinct().join(allowed.hint("merge"), "id", "left_semi"), "scope-members")
        shown = overview(nodes, ends, members).select("id") if members.limit(SHOWN + 1).count() > SHOWN else members
    else:
        shown = overview(nodes, ends, allowed).select("id")
    if path:
        wanted = spark.createDataFrame([(p,) for p in path], "id string")
        shown = shown.unionAll(nodes.select("id").join(wanted.hint("merge"), "id", "left_semi"))
    return shown.distinct()


# Hops of a neighbourhood where none are given, and at most.
HOPS, MOST_HOPS = 2, 6


def filtered(edges: DataFrame, types: tuple[str, ...] = (), begin: str | None = None, end: str | None = None) -> DataFrame:
    """The edges(relationship, seen_at, ...) of some types within a window of time, both ends included. Types that no edge has are
    ignored, and if none is left there is no such filter; edges without a time pass every window; begin after end is an error."""
    if begin and end and begin > end:
        raise ValueError("begin after end")
    if types:
        known = [r.relationship for r in edges.where(F.col("relationship").isin(*types)).select("relationship").distinct().collect()]  # at most those given
        edges = edges.where(F.col("relationship").isin(*known)) if known else edges
    for bound, keeps in ((begin, lambda t: F.col("seen_at") >= t), (end, lambda t: F.col("seen_at") <= t)):
        if bound:
            edges = edges.where(F.col("seen_at").isNull() | keeps(F.lit(bound).cast("timestamp")))
    return edges


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): id and hop of all nodes within `hops` of a seed (id) by edges(source, target, ...) of either direction, and all edges
    among them. No hops or fewer mean HOPS, at most MOST_HOPS count. Nodes are joined, never collected."""
    depth = HOPS if hops <= 0 else min(hops, MOST_HOPS)
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionAll(edges.select("target", "source")).where("id <> other").distinct()
    both = stored(both, "neighbourhood-pairs")
    seen = stored(seeds.select("id", F.lit(0).alias("hop")).distinct(), "neighbourhood")
    frontier = seen
    for hop in range(1, depth + 1):
        new = both.join(frontier.select("id").hint("merge"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(seen.hint("merge"), "id", "left_anti")
        frontier = stored(new.select("id", F.lit(hop).alias("hop")), "neighbourhood")
        seen = seen.unionAll(frontier)
    ids = seen.select("id")
    inner = edges.join(ids.select(F.col("id").alias("source")).hint("merge"), "source", "left_semi").join(ids.select(F.col("id").alias("target")).hint("merge"), "target", "left_semi")
    return seen, inner.select(*edges.columns)
