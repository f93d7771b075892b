"""Iterative graph operators: ranks, hop distances and paths, betweenness, communities.

Edges are DataFrames (source, target); nodes are DataFrames (id). Every round is a join and an aggregate written to the
shared folder, so no graph, rank vector or frontier passes through the driver; only counts and sums do.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import discard, stored


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, seeds: DataFrame | None = None, normalised: bool = True) -> DataFrame:
    """id, rank. Parallel edges add weight. Stops after `rounds`, or when the summed change is under tolerance * nodes.

    normalised: ranks sum to 1 and nodes without out-edges spread theirs evenly. Otherwise each node gets
    (1 - damping) plus what flows in; with seeds (id), only they get that restart term.
    """
    nodes = stored(nodes.select("id"), "nodes")
    n = nodes.count()
    pairs = edges.groupBy("source", "target").agg(F.count("*").alias("w"))
    out = pairs.groupBy("source").agg(F.sum("w").alias("total"))
    links = stored(pairs.join(out, "source").select("source", "target", (F.col("w") / F.col("total")).alias("share")), "links")
    start = F.lit(1.0 / n if normalised and n else 1 - damping)
    restart = F.lit((1 - damping) / n if normalised and n else 1 - damping)
    seen = links.select(F.col("source").alias("id"), F.lit(True).alias("sends"), F.lit(False).alias("takes")).unionAll(links.select("target", F.lit(False), F.lit(True)))
    base = nodes.join(seen.groupBy("id").agg(F.max("sends").alias("sends"), F.max("takes").alias("takes")).hint("merge"), "id", "left")
    if seeds is None:
        base = base.withColumn("restart", restart)
    else:
        chosen = seeds.select("id").distinct().withColumn("seed", F.lit(True))
        base = base.join(chosen, "id", "left").withColumn("restart", F.when(F.col("seed"), restart).otherwise(0.0))
    base = stored(base.select("id", F.coalesce("sends", F.lit(False)).alias("sends"), F.coalesce("takes", F.lit(False)).alias("takes"), "restart"), "rank-nodes")
    if tolerance is None and rounds and n:
        return _ranks_by_core(base, links, n, rounds, damping, None if seeds is not None else 1.0 / n if normalised else 1 - damping, normalised)
    ranks = base.select("id", "sends", (start if seeds is None else F.col("restart")).alias("rank"))
    for _ in range(rounds if n else 0):
        lost = ranks.where("not sends").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if normalised else 0.0
        flow = links.join(ranks, links.source == ranks.id).groupBy("target").agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        old = ranks.select(F.col("id").alias("was"), F.col("rank").alias("before"))
        now = base.join(flow, base.id == flow.target, "left")
        now = stored(now.select("id", "sends", (F.col("restart") + damping * (F.coalesce("flow", F.lit(0.0)) + lost / n)).alias("rank")), "ranks")
        change = now.join(old, now.id == old.was).agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        if change < tolerance * n:
            return now.select("id", "rank")
        ranks = now
    return ranks.select("id", "rank")


def _ranks_by_core(base: DataFrame, links: DataFrame, n: int, rounds: int, damping: float, start: float | None, normalised: bool) -> DataFrame:
    """The ranks of pagerank() after `rounds` on base(id, sends, takes, restart) and links(source, target, share). start: that of all
    nodes; None: their restart term.

    Only nodes that both take and send (the core) are ranked round by round. A node that takes nothing has its restart term and the
    common share of what is lost, so what such nodes send is summed once for each target: `fixed` times 1 and `even` times a number.
    What nodes without out-edges take is only summed until the last round, in which each gets its own.
    """
    sender = base.where("sends").select(F.col("id").alias("source"), F.col("takes").alias("core"), "restart")
    ends = base.select(F.col("id").alias("target"), F.col("sends").alias("on"))
    even = links.join(sender.where("not core").hint("merge"), "source").groupBy("target").agg(F.sum(F.col("share") * F.col("restart")).alias("fixed"), F.sum("share").alias("even"))
    inflow = stored(even.join(ends.hint("merge"), "target"), "rank-inflow")
    within = stored(links.join(sender.where("core").select("source"), "source").join(ends.hint("merge"), "target").select("source", "target", "on", "share"), "core-links")
    among = within.where("on")
    to_ends = within.where("not on").groupBy(F.col("source").alias("id")).agg(F.sum("share").alias("ends"))
    zero = lambda *names: [F.coalesce(c, F.lit(0.0)).alias(c) for c in names]
    core = base.where("sends and takes").select("id", "restart").join(inflow.select(F.col("target").alias("id"), "fixed", "even"), "id", "left").join(to_ends, "id", "left")
    core = stored(core.select("id", "restart", *zero("fixed", "even", "ends")), "core-nodes")
    to_end = inflow.where("not on").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("fixed", "even")]).first()
    silent = base.where("not sends").agg(F.count("*"), F.coalesce(F.sum("restart"), F.lit(0.0))).first()
    # a node that takes nothing has once * restart + common
    once, common = (1.0, 0.0) if start is None else (0.0, start)
    lost = (silent[1] if start is None else silent[0] * start) if normalised else 0.0
    ranks = core.select("id", "ends", (F.col("restart") if start is None else F.lit(start)).alias("rank"))
    gain = lambda: F.coalesce("flow", F.lit(0.0)) + once * F.col("fixed") + common * F.col("even") + lost / n
    for turn in range(rounds - 1):
        flow = among.join(ranks, among.source == ranks.id).groupBy("target").agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        now = core.join(flow, core.id == flow.target, "left").select("id", "ends", (F.col("restart") + damping * gain()).alias("rank"))
        if normalised:
            sent = ranks.agg(F.coalesce(F.sum(F.col("rank") * F.col("ends")), F.lit(0.0))).first()[0] + once * to_end[0] + common * to_end[1]
            once, common, lost = 1.0, damping * lost / n, silent[1] + damping * (sent + silent[0] * lost / n)
        else:
            once, common = 1.0, 0.0
        ranks = stored(now, "ranks") if normalised or turn % 4 == 3 or turn == rounds - 2 else now  # else a few rounds make one job
    flow = within.join(ranks, within.source == ranks.id).groupBy("target").agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
    parts = flow.select("target", "flow", F.lit(0.0).alias("fixed"), F.lit(0.0).alias("even")).unionByName(inflow.select("target", F.lit(0.0).alias("flow"), "fixed", "even"))
    last = parts.groupBy("target").agg(*[F.sum(c).alias(c) for c in ("flow", "fixed", "even")])
    last = base.join(last.hint("merge"), base.id == last.target, "left").select("id", "restart", *zero("flow", "fixed", "even"))
    return last.select("id", (F.col("restart") + damping * gain()).alias("rank"))


def hop_paths(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """seed, id, hops, path: a shortest directed path from each seed to every node within depth, least by its ids.

    Breadth first, one round a hop; give edges both ways for undirected paths. A depth of 0 or less takes 2.
    """
    depth = depth if depth > 0 else 2
    steps = stored(edges.select("source", "target").distinct(), "steps")
    frontier = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"), F.array("id").alias("path")).distinct(), "hops-0")
    levels = [frontier]
    for hop in range(1, depth + 1):
        found = frontier.join(steps, frontier.id == steps.source).groupBy("seed", F.col("target").alias("to")).agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.unionAll, levels).select(F.col("seed").alias("s"), F.col("id").alias("i"))
        found = found.join(seen, (F.col("seed") == F.col("s")) & (F.col("to") == F.col("i")), "left_anti")
        found = found.select("seed", F.col("to").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("to")).alias("path"))
        frontier = stored(found, f"hops-{hop}")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionAll, levels)


def neighbours(ends: DataFrame) -> DataFrame:
    """The different (id, other) of ends that are not one node."""
    return ends.where("id <> other").select("id", "other").distinct()


def hop_expansion(ends: DataFrame, start: DataFrame, most: tuple[int, ...] = (48, 24, 16), total: int = 90, allowed: DataFrame | None = None) -> DataFrame:
    """id, hop: from start (id), at each hop the `most` new neighbours of greatest degree, ties to the lesser id; at most total nodes.

    ends has each edge both ways as (id, other); degree counts different neighbours, whether allowed or not. Only nodes of allowed(id),
    where given, are reached: the new ones of a hop are looked up there, not the whole graph. The frontier never exceeds most.
    """
    pairs = stored(neighbours(ends), "neighbours")
    degree = stored(pairs.groupBy("id").agg(F.count("*").alias("d")), "degrees")
    levels = [stored(start.select("id", F.lit(0).alias("hop")), "expansion")]
    room = total - levels[0].count()
    for hop, cap in enumerate(most, 1):
        if min(cap, room) <= 0:
            break
        seen = reduce(DataFrame.unionAll, levels)
        new = pairs.join(levels[-1].select("id"), "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        new = new if allowed is None else new.join(allowed.hint("merge"), "id", "left_semi")
        new = new.join(degree, "id").orderBy(F.desc("d"), "id").limit(min(cap, room))
        levels.append(stored(new.select("id", F.lit(hop).alias("hop")), "expansion"))
        room -= levels[-1].count()
    return reduce(DataFrame.unionAll, levels)


def _dependencies(starts: DataFrame, steps: DataFrame, inner: DataFrame) -> DataFrame | None:
    """(seed, id, delta): what share of the shortest paths from each start passes each node on the way, summed over their ends.
    None if no path has a node on its way. inner: the steps from nodes that have steps into them; all but the first of a path are such."""
    frontier = stored(starts.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("sigma")), "level-0")
    levels = [frontier]
    while True:
        by = steps if len(levels) == 1 else inner
        found = frontier.join(by, frontier.id == by.source).groupBy("seed", F.col("target").alias("to")).agg(F.sum("sigma").alias("sigma"))
        seen = reduce(DataFrame.unionAll, levels).select(F.col("seed").alias("s"), F.col("id").alias("i"))
        found = found.join(seen, (F.col("seed") == F.col("s")) & (F.col("to") == F.col("i")), "left_anti")
        frontier = stored(found.select("seed", F.col("to").alias("id"), "sigma"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    after = levels[-1].withColumn("delta", F.lit(0.0))
    sums = []
    for level in reversed(levels[1:-1]):
        back = after.select(F.col("seed").alias("s"), F.col("id").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("part"))
        gains = back.join(inner, back.v == inner.target).groupBy("s", F.col("source").alias("u")).agg(F.sum("part").alias("part"))
        joined = level.join(gains, (level.seed == gains.s) & (level.id == gains.u), "left")
        after = stored(joined.select("seed", "id", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta")), "deltas")
        sums.append(after.select("seed", "id", "delta"))
    return reduce(DataFrame.unionAll, sums).where("delta > 0") if sums else None


def betweenness(nodes: DataFrame, edges: DataFrame, error: float | None = None, risk: float = 0.05, exact_below: int = 2000, first: int = 256) -> DataFrame:
    """id, betweenness: directed, unweighted, divided by (n - 1)(n - 2); parallel edges count once.

    Exact, at a cost of nodes times edges, without an error or for less than exact_below nodes. Else shortest paths start from
    `first` nodes (in the order of a hash), then from as many again and again, until the values of all nodes are within `error` of the
    exact ones but for a chance of `risk` (an empirical Bernstein bound over all nodes and rounds), or all nodes have been starts.
    Every start sees the whole graph. A start's contribution to a node is at most n - 2, so the bound needs no more starts on a
    larger graph than its logarithm asks for.
    """
    nodes = stored(nodes.select("id"), "nodes")
    n = nodes.count()
    steps = stored(edges.where("source <> target").select("source", "target").distinct(), "steps")
    zero = nodes.select("id", F.lit(0.0).alias("betweenness"))
    if n <= 2:
        return zero
    inner = stored(steps.join(steps.select(F.col("target").alias("into")).distinct().hint("merge"), F.col("source") == F.col("into"), "left_semi"), "inner-steps")
    sampled = error is not None and n >= exact_below
    order = nodes.select("id", F.xxhash64("id").alias("h"))
    used, size, sums = 0, first if sampled else n, None
    most_rounds = math.ceil(math.log2(n / first + 1)) + 1
    last = None
    while used < n:
        left = order if last is None else order.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("id") > last[1])))
        starts = stored(left.orderBy("h", "id").limit(size) if used + size < n else left, "starts")
        deltas = _dependencies(starts.select("id"), steps, inner)
        if deltas is not None:
            x = F.col("delta") / (n - 2)
            part = deltas.where("seed <> id").groupBy("id").agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
            sums = stored(part if sums is None else sums.unionAll(part).groupBy("id").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")), "dependencies")
        used += starts.count()
        if used >= n:
            break
        last = starts.agg(F.max(F.struct("h", "id")).alias("m")).head().m
        odds = math.log(2 * n * most_rounds / risk)
        spread = 0.0 if sums is None else (sums.agg(F.max((F.col("s2") - F.col("s1") * F.col("s1") / used) / (used - 1))).head()[0] or 0.0)
        if math.sqrt(2 * max(spread, 0.0) * odds / used) + 7 * odds / (3 * (used - 1)) <= error * (n - 1) / n:
            break
        size = used
    if sums is None:
        return zero
    scale = n / used / (n - 1)
    return nodes.join(sums.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").select("id", (F.coalesce("s1", F.lit(0.0)) * scale).alias("betweenness"))


#: Rows of a group that _fitting() sorts in one task; larger groups are dealt to lines.
LINE = 500_000


def _fitting(best: DataFrame, m2: float, nodes: int) -> DataFrame:
    """best(v, k, sweep, home, least, top, stay, tot, members) with `fits`: the node still gains after those with a greater gain by weight that
    move this time into the community it would enter, or out of the one it would leave.

    Each of these takes k / m2 of the gain by weight of the nodes behind it; without this nodes that leave a heavy community together
    make it light and all come back. In a group of several lines the weight ahead is that of the own line times the lines, and one line
    each sweep has no others before it, so that a node that is alone can always move.
    """
    can = (F.pmod(F.xxhash64("v", "sweep"), F.lit(2)) == 0) & (F.col("top") > F.col("stay"))
    told = best.withColumns({"can": can, "by_weight": (F.col("top") - F.col("stay")) / F.col("k")})
    ahead = F.lit(0.0)
    for side, community, most in (("into", "least", F.least("tot", F.lit(float(nodes)))), ("from", "home", F.col("members"))):
        lines = (1 + F.floor(most / LINE)).cast("int")
        told = told.withColumn(f"lines_{side}", lines).withColumn(f"line_{side}", F.pmod(F.xxhash64("v", F.lit(side), "sweep"), F.when(F.col("can"), F.col(f"lines_{side}")).otherwise(64)).cast("int"))
        group = Window.partitionBy(F.when(F.col("can"), F.col(community)), f"line_{side}").orderBy(F.desc("by_weight"), "v").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("k").over(group), F.lit(0.0)) * F.col(f"lines_{side}")
        others = F.when(F.col(f"line_{side}") == F.col("sweep") % F.col(f"lines_{side}"), 0.0).otherwise(F.col("k") * (F.col(f"lines_{side}") - 1))
        told = told.withColumn(f"ahead_{side}", before + others)
        ahead = ahead + F.col(f"ahead_{side}")
    return told.withColumn("fits", F.col("can") & (F.col("by_weight") > ahead / m2))


#: Nodes that have moved, and communities, go to every task up to FEW. Of fewer links than MANY no weights are kept: it costs more than it saves.
FEW, MANY = 100_000, 1_000_000


def _weights(links: DataFrame, state: DataFrame, before: DataFrame | None, moved: DataFrame | None) -> DataFrame:
    """(v, c, w, home, k, sweep): each node's weight to the communities around it and to its own, with what state(v, k, c, sweep) says of it.

    From all links, or from the weights of the sweep before and the few nodes moved(v, home, c) since: only their neighbours' weights
    have changed, by whole numbers, so both give the same.
    """
    own, zero = state.select("v", F.col("c").alias("home"), "k", "sweep"), state.select("v", "c", F.lit(0.0).alias("w"))
    others = links.where("a <> b")
    if before is None:
        to = others.join(state.select(F.col("v").alias("b"), "c").hint("merge"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
    else:
        change = F.array(F.struct(F.col("home").alias("c"), (-F.col("w")).alias("w")), F.struct("c", "w"))
        gone = others.join(F.broadcast(moved.withColumnRenamed("v", "a")), "a").select(F.col("b").alias("v"), F.inline(change))
        to = before.select("v", "c", "w").unionByName(gone)
    summed = to.unionByName(zero).repartition("v").groupBy("v", "c").agg(F.sum("w").alias("w"))
    return summed.join(own.hint("merge"), "v").where("w > 0 or c = home")


def communities(nodes: DataFrame, edges: DataFrame, sweeps: int = 200, levels: int = 50) -> DataFrame:
    """id, community: Louvain on the undirected graph, an edge's weight being the number of parallel edges.

    In each sweep a half of the nodes (by a hash that differs from sweep to sweep, so that neighbours do not swap for ever) moves to
    the neighbouring community of greatest modularity gain, ties to the least name, as far as the moves of the sweep leave each
    other a gain, until no node wants to move; then communities become nodes, until nothing moves. Every node comes back once; a
    community is named by its least id. An error if more sweeps or levels than allowed would be needed. Once few nodes move in
    a large graph, weights are kept from sweep to sweep, and only the links of those that moved are looked at.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(edges.select("target", "source"))
    links = stored(both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "community-links")
    member = nodes.select("id", F.col("id").alias("community"))
    m2 = links.agg(F.sum("w")).first()[0]
    for _ in range(levels if m2 else 0):
        degree = stored(links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")), "degrees")
        state, moved_at_all, n = degree.select("v", "k", F.col("v").alias("c"), F.lit(0).alias("sweep")), False, degree.count()
        moved, groups, kept, last, large = n, n, None, None, links.count() >= MANY
        for _ in range(sweeps):  # the number of a sweep is a column, so that all sweeps share their compiled code
            tot = state.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
            few = large and moved <= min(FEW, n / 8)
            weights = _weights(links, state, kept if few else None, last)
            if few:
                weights = stored(weights, "community-weights")
            if kept is not None:
                discard(kept)
            kept = weights if few else None
            choice = weights.join(tot.hint("broadcast" if groups <= FEW else "merge"), "c")
            at_home = F.col("c") == F.col("home")
            inside = F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)
            choice = choice.withColumn("gain", F.round(F.col("w") - F.col("k") * inside / m2, 9))
            best = choice.groupBy("v").agg(
                F.min(F.struct((0.0 - F.col("gain")).alias("loss"), "c", "tot")).alias("best"), F.max(F.when(at_home, F.col("gain"))).alias("stay"),
                F.max(F.when(at_home, F.col("members"))).alias("members"), F.first("home").alias("home"), F.first("k").alias("k"), F.first("sweep").alias("sweep"),
            )
            best = best.select("v", "k", "sweep", "home", "stay", "members", (0.0 - F.col("best.loss")).alias("top"), F.col("best.c").alias("least"), F.col("best.tot").alias("tot"))
            new = _fitting(best, m2, n).select("v", "k", (F.col("sweep") + 1).alias("sweep"), F.when(F.col("fits"), F.col("least")).otherwise(F.col("home")).alias("c"), "home", (F.col("top") > F.col("stay")).alias("wants"))
            new = stored(new, "community-state")
            wanted, moved, groups = new.agg(F.count_if("wants"), F.count_if(F.col("c") != F.col("home")), F.approx_count_distinct("c")).first()
            state, moved_at_all = new.select("v", "k", "c", "sweep"), moved_at_all or moved > 0
            last = new.where("c <> home").select("v", "home", "c")
            if not wanted:
                break
        else:
            raise RuntimeError(f"nodes still want to move after {sweeps} sweeps")
        if not moved_at_all:
            break
        step = state.select(F.col("v").alias("community"), F.col("c").alias("into"))
        member = stored(member.join(step, "community", "left").select("id", F.coalesce("into", "community").alias("community")), "members")
        ends = state.select(F.col("v").alias("a"), F.col("c").alias("ca"))
        other = state.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        links = stored(links.join(ends, "a").join(other, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "community-links")
    else:
        if m2:
            raise RuntimeError(f"communities still join after {levels} levels")
    named = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(named, "community").select("id", F.col("name").alias("community"))
