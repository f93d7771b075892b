"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on at most SAMPLE distinct vectors, each tree in a task of its own: a node projects on the difference
of two centres that start at random vectors of the node, and cuts at the median. All distinct vectors are indexed. A query
keeps one priority queue over all trees: it opens the branch with the smallest sum of squared margins so far until it
has opened OPEN times the square root of the number of fitted vectors. Neighbouring leaves form bundles; a query goes once to
each bundle with the list of leaves that it asks for, and candidates are ranked exactly (cosine in double precision on the
original vectors). A leaf that holds many more vectors than the sample had there gets a tree of its own in its task.
Equal vectors are one entry with its k + 1 least ids, so a vector that a third of the rows share is one candidate. Bundles
of many vectors or queries are dealt to several tasks.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.llm.common import materialise

SAMPLE, TREES, LEAF, OPEN = 65_536, 16, 24, 4.0
#: Vectors and queries of a bundle in one task; a leaf of more than SPLIT vectors is searched by a tree of its own, WITHIN leaves a query.
BUNDLE, QUERIES, SPLIT, WITHIN = 32_768, 4096, 8 * LEAF, 8
#: Vectors of different lengths have no cosine; each length is searched by itself, at most so many.
MOST_LENGTHS = 32


def _matrix(column) -> np.ndarray:
    """Vectors scaled by a power of two each, which changes no cosine and keeps squares finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(some: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The difference of two centres of the vectors, from two random ones in a few steps."""
    two = some[rng.choice(len(some), 2, replace=False)]
    for _ in range(4):
        side = some @ (two[0] - two[1]) > 0
        if side.all() or not side.any():
            break
        two = np.stack([some[side].mean(0), some[~side].mean(0)])
    return two[0] - two[1]


class Forest:
    """One array of nodes for all trees: a normal and a threshold, or a leaf (child < 0 is leaf number -child - 1).

    Leaves are numbered from left to right, tree after tree.
    """

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        """Trees of grow(): normals, cuts, children, number of leaves; the first node is the root."""
        self.roots, nodes, self.leaves, children = [], 0, 0, []
        for normals, cuts, kids, n_leaves in trees:
            self.roots.append(nodes if len(cuts) else -self.leaves - 1)
            children.append(np.where(kids >= 0, kids + nodes, kids - self.leaves))
            nodes += len(cuts)
            self.leaves += n_leaves
        width = trees[0][0].shape[1]
        self.normals = np.concatenate([t[0] for t in trees]).reshape(-1, width)
        self.cuts, self.children = np.concatenate([t[1] for t in trees]), np.concatenate(children).reshape(-1, 2)

    @staticmethod
    def grow(points: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        rng = np.random.default_rng(seed)
        normals, cuts, children, leaves = [], [], [], 0
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = None
            for _ in range(4 if len(rows) > leaf else 0):
                normal = centres(points[rows if len(rows) <= 256 else rng.choice(rows, 256, replace=False)], rng)
                size = np.linalg.norm(normal)
                if size > 1e-12:
                    along = points[rows] @ (normal / size)
                    cut = float(np.median(along))
                    right = along > cut
                    if 0 < right.sum() < len(rows):
                        split = normal / size, cut, right
                        break
            if split is None:
                leaves += 1
                here = -leaves
            else:
                here = len(cuts)
                normals.append(split[0])
                cuts.append(split[1])
                children.append([0, 0])
                todo += [(rows[split[2]], here, 1), (rows[~split[2]], here, 0)]
            if parent >= 0:
                children[parent][side] = here
        return np.array(normals).reshape(len(cuts), points.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(points), root, np.int64)
            while (open_ := np.flatnonzero(node >= 0)).size:
                at = node[open_]
                right = np.einsum("ij,ij->i", points[open_], self.normals[at]) > self.cuts[at]
                node[open_] = self.children[at, right.astype(int)]
            out[:, t] = -node - 1
        return out

    def search(self, point: np.ndarray, leaves: int) -> list[int]:
        """The first leaves by the sum of squared margins, all trees in one queue."""
        margins = (self.normals @ point - self.cuts).tolist() if len(self.cuts) else []
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found = []
        while queue and len(found) < leaves:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near = 1 if m > 0 else 0
                heapq.heappush(queue, (far + m * m, int(self.children[node, 1 - near])))
                node = int(self.children[node, near])
            found.append(-node - 1)
        return found


def fit(sample: np.ndarray, trees: int, leaf: int, spark: SparkSession) -> Forest:
    """A forest on unit vectors; each tree grows in a task."""
    shared = spark.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                normals, cuts, children, leaves = Forest.grow(shared.value, leaf, seed)
                columns = [[normals.astype(np.float32).tobytes()], [cuts.tobytes()], [children.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array([seed]), *(pa.array(x, pa.binary()) for x in columns), pa.array([leaves], pa.int64())], names=["id", "normals", "cuts", "children", "leaves"])

    table = spark.range(0, trees, 1, trees).mapInArrow(run, "id long, normals binary, cuts binary, children binary, leaves long").toArrow().sort_by("id")
    grown = []
    for row in table.to_pylist():
        normals = np.frombuffer(row["normals"], np.float32).reshape(-1, sample.shape[1])
        grown.append((normals, np.frombuffer(row["cuts"]), np.frombuffer(row["children"], np.int64).reshape(-1, 2), row["leaves"]))
    return Forest(grown)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: distinct rows with an id and a finite vector other than zero."""
    v = F.col(embedding)
    finite = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).distinct()


def candidates(x: np.ndarray, rows: np.ndarray, q: np.ndarray, asking: np.ndarray):
    """Pairs of blocks (rows, queries) to compare: all, or by a tree of the rows' own where they are many."""
    if len(rows) <= SPLIT:
        for i in range(0, len(asking), 256):
            yield rows, asking[i : i + 256]
        return
    own = _unit(x[rows])
    tree = Forest([Forest.grow(own, LEAF, 7)])
    leaf = tree.place(own)[:, 0]
    order = np.argsort(leaf, kind="stable")
    begins = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    wanted: dict[int, list[int]] = {}
    for i, point in zip(asking.tolist(), _unit(q[asking])):
        for y in tree.search(point, WITHIN):
            wanted.setdefault(y, []).append(i)
    for y, some in wanted.items():
        yield rows[order[begins[y] : begins[y + 1]]], np.array(some)


def _nearest_of_length(rows: DataFrame, is_query, k: int, trees: int, open_: float) -> DataFrame:
    spark = rows.sparkSession
    by_id = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries = materialise(ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    n_entries = entries.count()
    some = entries if n_entries <= SAMPLE else entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(SAMPLE / n_entries * (1 << 30)))
    sample = some.limit(2 * SAMPLE).select("v").toArrow().column("v")
    forest = fit(_unit(_matrix(sample)), trees, LEAF, spark)
    shared = spark.sparkContext.broadcast(forest)
    leaves = math.ceil(open_ * math.sqrt(len(sample)))
    kind = rows.schema["v"].dataType.simpleString()
    bundles = -(-n_entries * trees // BUNDLE)
    together = max(1, -(-forest.leaves // bundles))

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(_unit(_matrix(batch.column(0))))
                for t in range(leaf.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t] // together), pa.array(leaf[:, t]), batch.column(0), batch.column(1)], names=["bundle", "leaf", "v", "ids"])

    def ask(batches):
        for batch in batches:
            bundle, which, wanted = [], [], []
            for i, q in enumerate(_unit(_matrix(batch.column(1))) if batch.num_rows else []):
                by_bundle: dict[int, list[int]] = {}
                for leaf in shared.value.search(q, leaves):
                    by_bundle.setdefault(leaf // together, []).append(leaf)
                bundle += by_bundle
                wanted += by_bundle.values()
                which += [i] * len(by_bundle)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(wanted, pa.list_(pa.int64()))], names=["bundle", "query_id", "q", "leaves"])

    indexed = materialise(entries.mapInArrow(index, f"bundle long, leaf long, v {kind}, ids array<long>"), "indexed")
    asked = materialise(rows.where(is_query).select("vec_id", "v").mapInArrow(ask, f"bundle long, query_id long, q {kind}, leaves array<long>"), "asked")
    # one row for each bundle; the sample bounds their number
    n = lambda df, most, name: materialise(df.groupBy("bundle").agg(F.ceil(F.count("*") / most).cast("int").alias(name)), name)
    parts, turns = F.broadcast(n(indexed, 2 * BUNDLE, "parts")), F.broadcast(n(asked, QUERIES, "turns"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    indexed = indexed.join(turns, "bundle").join(parts, "bundle").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("turn", every("turns"))
    asked = asked.join(turns, "bundle").join(parts, "bundle").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).withColumn("part", every("parts"))
    indexed, asked = indexed.drop("parts", "turns"), asked.drop("parts", "turns")

    def rank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        """The k + 1 best entries of each query in the leaves of a bundle."""
        names = ["query_id", "ids", "score"]
        take, who, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if entries.num_rows and queries.num_rows:
            x, q = _matrix(entries.column("v")), _matrix(queries.column("q"))
            xn, qn = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            first = np.array([i[0] for i in entries.column("ids").to_pylist()])
            query = queries.column("query_id").to_numpy()
            lists = queries.column("leaves").combine_chunks()
            asks, asking = lists.flatten().to_numpy(), np.repeat(np.arange(len(query)), lists.value_lengths().to_numpy())
            at = entries.column("leaf").to_numpy()
            order, asked_order = np.argsort(at, kind="stable"), np.argsort(asks, kind="stable")
            for leaf in np.intersect1d(at, asks):
                rows = order[slice(*np.searchsorted(at[order], [leaf, leaf + 1]))]
                some = asking[asked_order[slice(*np.searchsorted(asks[asked_order], [leaf, leaf + 1]))]]
                for block, part in candidates(x, rows, q, some):
                    cosine = (q[part] @ x[block].T) / np.outer(qn[part], xn[block])
                    top = np.lexsort((np.broadcast_to(first[block], cosine.shape), -cosine), axis=1)[:, : k + 1]
                    take.append(block[top].ravel())
                    who.append(np.repeat(part, top.shape[1]))
                    scores.append(np.take_along_axis(cosine, top, 1).ravel())
            take, who, scores = np.concatenate(take), np.concatenate(who), np.concatenate(scores)
            _, once = np.unique(np.column_stack([query[who], first[take]]), axis=0, return_index=True)
            take, who, scores = take[once], who[once], scores[once]
            best = np.lexsort((first[take], -scores, query[who]))
            begins = np.flatnonzero(np.append(True, np.diff(query[who[best]]) != 0))
            kept = best[np.arange(len(best)) - np.repeat(begins, np.diff(np.append(begins, len(best)))) <= k]
            return pa.table([queries.column("query_id").take(pa.array(who[kept])), entries.column("ids").take(pa.array(take[kept])), pa.array(scores[kept])], names=names)
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.float64())], names=names)

    keys = ["bundle", "part", "turn"]
    found = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rank, "query_id long, ids array<long>, score double")
    # an entry may come from several trees: its first id stands for it
    entry = found.groupBy("query_id", F.element_at("ids", 1).alias("first")).agg(F.max(F.struct("score", "ids")).alias("b"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    spread = entry.select("query_id", F.col("b.score").alias("score"), F.explode("b.ids").alias("vec_id")).where("vec_id <> query_id")
    return spread.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, open_: float = OPEN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest candidates by cosine, ties to the smaller vec_id.

    is_query is a condition on vec_id. Candidates are all other ids. Rows with a null id or a vector that usable() leaves
    out take no part; repeated rows count once; an empty table gives no rows. Vectors of different lengths are not
    compared: each length has its own search, and more than MOST_LENGTHS lengths are an error. An id that has vectors of
    several lengths is a query of each.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, vec_id, embedding), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        found = _nearest_of_length(rows.where(F.size("v") == n), is_query, k, trees, open_)
        out = found if len(lengths) == 1 else out.union(found)
    return out


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
