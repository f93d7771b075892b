"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks; two that differ in three bits or fewer agree in three blocks at least, so
every three blocks are a key. Distinct fingerprints are joined on their keys by sorting them together, and each bucket yields only a
spanning forest of its links (at most one edge for each member), never its pairs: a bucket is walked breadth first,
and members that are reached are not compared again. A bucket of more than TILE fingerprints is cut into tiles that
meet pairwise, so no task holds more than two tiles. Links then become components by alternating large-star and
small-star rounds on the edge table, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import add_columns, materialise, utf8

TILE = 4096
SMALL = 48
SEED = 42
#: Shingles in a tile of the exact comparison; two tiles (eight bytes a shingle) meet in a task.
TILE_SHINGLES = 4_000_000
#: Hot buckets up to this many are broadcast.
MOST_HOT = 100_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of width words (A-Z lower-cased, space-joined); of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = list(map(len, words))
    ends = [e - 1 for e in accumulate(n + 1 for n in lengths)]
    starts = [e - n for e, n in zip(ends, lengths)]
    h = xxhash.xxh64_intdigest
    tails = ends[width - 1 :] or ends[-1:]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, tails)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Majority bits of the hashes, big-endian, 64 bits for each of words (further words take remixed hashes); zero for none."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for k in range(words):
        x = hashes
        if k:
            x = x + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        n = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 16):
            part = x[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            n += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * n > len(x)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, words: int = 1, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with fp, the binary fingerprint. Null and empty texts have the zero fingerprint."""
    return add_columns(docs, [text], lambda c: [[fingerprint(shingle_hashes(t, width), words) for t in utf8(c)]], "fp binary", drop)


def _as_words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def forest(bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most `most` differing bits) among the rows of bits."""
    left, out = np.arange(len(bits)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _distance(bits[left], bits[at]) <= most
            if near.any():
                reached = left[near].tolist()
                out += [(at, x) for x in reached]
                todo += reached
                left = left[~near]
    return out


def _links(group: np.ndarray, bits: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Forest edges within each run of equal group numbers."""
    edge = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.concatenate([[0], edge]), np.append(edge, len(group))
    sizes = ends - starts
    a, b = [], []
    for i in np.flatnonzero(sizes > SMALL):
        for x, y in forest(bits[starts[i] : ends[i]], most):
            a.append(int(starts[i]) + x)
            b.append(int(starts[i]) + y)
    small = np.repeat(sizes <= SMALL, sizes)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for shift in range(1, int(min(sizes.max(), SMALL))):
        at = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:]))
        for x in at[_distance(bits[at], bits[at + shift]) <= most].tolist():
            p, q = find(x), find(x + shift)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(x + shift)
    return a, b


def triples() -> Column:
    """The 20 keys of a 64-bit fingerprint: every three of its six blocks of ten or eleven bits.

    Fingerprints with three differing bits or fewer agree in three blocks at least, so they share a key. A key has 31 to 33
    bits, so buckets stay small where fingerprints are many.
    """
    half = [F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("long") for at in (1, 5)]
    block = [F.shiftright(h, by).bitwiseAND((1 << n) - 1) for h in half for by, n in ((21, 11), (10, 11), (0, 10))]
    return F.array(*[a + F.shiftleft(b, 11) + F.shiftleft(c, 22) for a, b, c in combinations(block, 3)])


def byte_pairs(n_blocks: int, cuts: int) -> Column:
    """The keys of a fingerprint of n_blocks * 16 bits: two bytes each; cut c pairs byte 2 * i with the byte 2 * c + 1 further on."""
    two = lambda i, j: F.conv(F.concat(F.hex(F.substring("fp", i + 1, 1)), F.hex(F.substring("fp", j + 1, 1))), 16, 10).cast("long")
    return F.array(*[two(2 * i, (2 * i + 2 * c + 1) % (2 * n_blocks)) for c in range(cuts) for i in range(n_blocks)])


def near_links(distinct: DataFrame, most: int = 3, keys: Column | None = None) -> DataFrame:
    """a, b: fingerprints with at most `most` differing bits, enough of them to connect every linked group.

    distinct has one row for each fp; keys is an array of longs, the triples() of a 64-bit fingerprint by default. Links
    between fingerprints that share no key are missed; with the triples and three bits there are none.
    """
    if keys is None and most > 3:
        raise ValueError("the triples find all links of at most three bits")
    keys = triples() if keys is None else keys
    blocks = distinct.select("fp", F.posexplode(keys).alias("block", "value"))
    # only buckets over a tile
    hot = blocks.groupBy("block", "value").count().where(F.col("count") > TILE).select("block", "value", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    hot = materialise(hot, "hot-buckets")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot.hint("merge")
    dealt = blocks.join(hot, ["block", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    dealt = dealt.select("block", "value", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "fp")
    parts = ["block", "value", "low", "high"]
    dealt = dealt.repartition(*parts).sortWithinPartitions(*parts)

    def run(batches):
        held_key, held = [], []

        def flush():
            if len(held) > 1:
                change = [0, *accumulate(int(x != y) for x, y in zip(held_key, held_key[1:]))]
                a, b = _links(np.array(change), _as_words(held), most)
                yield pa.RecordBatch.from_arrays([pa.array([held[i] for i in a], pa.binary()), pa.array([held[i] for i in b], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = batch.to_pydict()
            held_key += zip(*[columns[k] for k in parts])
            held += columns["fp"]
            if held and len(held) >= 20_000:  # all but the last bucket, which may go on in the next batch
                cut = len(held) - 1
                while cut and held_key[cut - 1] == held_key[-1]:
                    cut -= 1
                rest = held_key[cut:], held[cut:]
                if cut:
                    del held_key[cut:], held[cut:]
                    yield from flush()
                    held_key, held = rest
        yield from flush()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for every node of edges(a, b) but the roots themselves."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.select("a", "b")
        both = both.union(table.select("b", "a")) if large else both
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written, so that both sides of the join are plain exchanges, which Spark splits where one node has many edges
        least = materialise(least, "least")
        met = both.join(least.hint("merge"), both.a == least.u)
        if large:
            out = met.where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select("b", "m").union(least.select("u", "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def mark(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0]:  # until a round changes nothing: then all edges are stars
        edges = materialise(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, words: int = 1, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that links reach; one row for each row of docs.

    Null ids never are a component's id unless it has no other. Repeated rows each come back.
    """
    marked = materialise(fingerprints(docs.select(doc_id, text), text, width, words, drop=(text,)), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "distinct-fingerprints")
    links = components(near_links(distinct.select("fp"), most, None if words == 1 else byte_pairs(4 * words, 1)))
    rooted = distinct.join(links.hint("merge"), distinct.fp == links.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted-fingerprints")
    lowest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = rooted.select("fp", "root").join(lowest.hint("merge"), "root").select(F.col("fp").alias("own"), "component_id")
    named = materialise(named, "named-fingerprints")
    return marked.join(named.hint("merge"), marked.fp == named.own).select(doc_id, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar_forest(sets: list[np.ndarray], bits: np.ndarray, most: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted sets with a Jaccard similarity of at least `least`.

    Pairs with over `most` differing bits or too unlike sizes are not compared.
    """
    sizes = np.array(list(map(len, sets)), float)
    left, out = np.arange(len(sets)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            own, n = sets[at], sizes[at]
            near = (_distance(bits[left], bits[at]) <= most) & (np.minimum(sizes[left], n) >= least * np.maximum(sizes[left], n))
            for i in np.flatnonzero(near):
                other = sets[left[i]]
                if n and len(other):
                    found = np.searchsorted(own, other)
                    both = int((own[np.minimum(found, len(own) - 1)] == other).sum())
                    near[i] = both >= least * (n + len(other) - both)
            if near.any():
                reached = left[near].tolist()
                out += [(at, x) for x in reached]
                todo += reached
                left = left[~near]
    return out


def verified_links(sets: DataFrame, most: int, least: float) -> DataFrame:
    """a, b: a spanning forest of the similar pairs in each group of sets(node, root, fp, shingles).

    A group of over TILE_SHINGLES shingles is dealt to tiles that meet pairwise.
    """
    groups = sets.groupBy("root").agg(F.sum(F.length("shingles") / 8).alias("total")).where(F.col("total") > TILE_SHINGLES)
    hot = materialise(groups.select("root", F.ceil(F.col("total") / TILE_SHINGLES).cast("int").alias("tiles")), "hot-groups")
    dealt = sets.join(F.broadcast(hot), "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["root", "low", "high"]
    dealt = dealt.select("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "fp", "shingles")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        key, nodes, fps, held = None, [], [], []

        def flush():
            pairs = similar_forest(held, _as_words(fps), most, least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()), pa.array([nodes[y] for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(k)[i].as_py() for k in range(6)]
                if row[:3] != key:
                    yield flush()
                    key, nodes, fps, held = row[:3], [], [], []
                nodes.append(row[3])
                fps.append(row[4])
                held.append(np.frombuffer(row[5], np.uint64))
        yield flush()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, doc_id: str, text: str, width: int, words: int, most: int, least: float, cuts: int = 2) -> DataFrame:
    """doc_id, component_id: groups of rows linked by a Jaccard similarity of their shingle sets of at least `least`.

    docs must be a written table with distinct long ids. Fingerprints of the sets, in `cuts` cuts, only find the candidates
    (at most `most` differing bits); every link is decided on the sets themselves.
    """

    def sketch(column):
        rows = []
        for t in utf8(column):
            own = np.unique(shingle_hashes(t, width))
            rows.append((fingerprint(own, words), xxhash.xxh3_128_digest(own.tobytes())))
        return list(zip(*rows)) if rows else [[]] * 2

    marked = materialise(add_columns(docs.select(doc_id, text), [text], sketch, "fp binary, same binary", (text,)), "sketches")
    distinct = materialise(marked.groupBy("fp", "same").agg(F.min(doc_id).alias("node")), "distinct-sketches")
    links = components(near_links(distinct.select("fp").distinct(), most, byte_pairs(4 * words, cuts)))
    rooted = distinct.join(links.hint("merge"), distinct.fp == links.node, "left").select(distinct.node, "fp", "same", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted-sketches")
    several = materialise(rooted.groupBy("root").count().where("count > 1").select("root"), "several")
    asked = materialise(rooted.join(several.hint("merge"), "root").select("node", "root", "fp"), "candidates")
    found = docs.select(F.col(doc_id).alias("node"), text).join(asked.hint("merge"), "node")
    sets = add_columns(found, [text], lambda c: [[np.unique(shingle_hashes(t, width)).tobytes() for t in utf8(c)]], "shingles binary", (text,))
    sets = materialise(sets.select("node", "root", "fp", "shingles"), "shingle-sets")
    linked = components(verified_links(sets, most, least)).withColumnRenamed("node", "own")
    named = distinct.join(linked.hint("merge"), distinct.node == linked.own, "left")
    named = materialise(named.select("fp", "same", F.coalesce("root", distinct.node).alias("component_id")), "named-sketches")
    return marked.join(named.hint("merge"), ["fp", "same"]).select(doc_id, "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
