"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token pieces of at most `limit` tokens. Full pieces are sequences of their own. The others are dealt
evenly to shards of about SHARD pieces; each shard's packing evolves on several islands at once. A solution is a list
of bins. Crossover injects the well-filled bins of one parent whole into the other, drops the bins there that hold any
of the same pieces and puts the displaced pieces back by best fit, longest first. The first solutions are best fit of the
pieces in random orders. After each round an island's elite migrates to the next island of its shard. A shard stops as
soon as it needs no more bins than its tokens demand. Islands are rows of a table, so every round is one parallel pass.
Selection favours uneven fills, so what is left over gathers in few bins; these are opened at the end, and their pieces
are dealt to new shards, which evolve in the same way.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections.abc import Callable
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tracelink.llm.byte_grams import mix
from tracelink.llm.common import materialise, slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
END_ID = 0
SHARD, ISLANDS, ROUNDS, POPULATION, GENERATIONS = 4000, 2, 2, 3, 6
#: Bins filled less than the first (all that are not full) are opened again, and their pieces meet those of other shards; where these
#: are over half of all pieces, so that little would be left over for others, those filled less than the second.
TAIL_FILLS = (1.0, 0.9)
#: Times that tails meet at most; each time they are half of what they were or less.
LEVELS = 40
CACHE_UNITS = 1_000_000


#: Texts of these characters only have the pre-tokens that Pretokens
#: finds: no other character joins, splits or changes when such a text is normalised.
PLAIN = re.compile(r"[ \n\r\t!-~À-ÖØ-öø-ÿ]*")
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[ord(c) for c in " \n\r\t"]] = SPACE
CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = LETTER
CLASS[ord("0") : ord("9") + 1] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER[0x80:0x9F] += 32  # the second byte of the letters À to Þ
#: Endings after an apostrophe that are pre-tokens with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens of up to so many bytes are known by their bytes as three numbers.
SHORT = 24
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


def pretokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens in the lower-case bytes of plain texts, each of which ends with a line end.

    These are runs of letters, single digits, runs of other signs, and an apostrophe that begins such a run with its ending.
    """
    kind = CLASS[raw]
    before = np.append(np.uint8(SPACE), kind[:-1])
    begin = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    marks = np.flatnonzero(begin & (raw == ord("'")) & (np.append(kind[1:], np.uint8(SPACE)) == LETTER))
    if len(marks):
        first, second = raw[marks + 1], raw[np.minimum(marks + 2, len(raw) - 1)]
        length = np.zeros(len(marks), np.int64)
        for ending in ENDINGS:
            fits = first == ord(ending[0])
            if len(ending) > 1:
                fits &= second == ord(ending[1])
            length[fits] = len(ending)
        marks, length = marks[length > 0], length[length > 0]
        begin[marks + 1] = False
        after = marks + 1 + length
        begin[after[kind[after] == LETTER]] = True
    edge = np.flatnonzero(begin | ((kind == SPACE) & (before != SPACE)))
    at = np.flatnonzero(begin[edge])
    return edge[at], edge[at + 1]


class UnitCache:
    """Ids of texts, pre-token by pre-token; a text that is not plain is encoded by the tokenizer as a whole.

    Pre-tokens that were met stand in arrays sorted by a hash of their bytes, with the bytes themselves, so that each is
    compared and none mistaken. At most CACHE_UNITS are kept from slice to slice, those used last.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_blanks = Tokenizer.from_file(path)  # for pre-tokens of plain texts, which only blanks divide
        self.by_blanks.normalizer = normalizers.Sequence([])
        self.by_blanks.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True  # a pre-token's last id, and no other
        self.hashes = np.zeros(0, np.uint64)
        self.bytes = np.zeros((0, 3), np.uint64)
        self.place, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.slice = 0
        self._arrange()


    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), 5000):
            some = units[i : i + 5000]
            made = np.array(self.by_blanks.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(made)
            counts.append(np.diff(np.flatnonzero(self.ends[made]) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _arrange(self) -> None:
        order = np.argsort(self.hashes)
        self.hashes, self.bytes, self.place, self.count, self.used = (x[order] for x in (self.hashes, self.bytes, self.place, self.count, self.used))
        bits = max(1, len(order).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.sorted = np.append(self.hashes, np.uint64(2**64 - 1))

    def _find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places in the arrays; -1 for what is not there."""
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.sorted[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.sorted[at[behind]] < hashes[behind]]
        at[at >= len(self.hashes)] = -1
        if len(self.hashes):
            at[(self.bytes[at] != keys).any(1)] = -1
        return at

    def _learn(self, hashes: np.ndarray, keys: np.ndarray, texts: Callable[[np.ndarray], list[str]]) -> None:
        """Adds pre-tokens; of different ones with equal hashes only one, ever."""
        _, once = np.unique(hashes, return_index=True)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[once]), len(self.hashes) - 1)
            once = once[self.hashes[at] != hashes[once]]
        if not len(once):
            return
        if len(self.hashes) > CACHE_UNITS:
            kept = np.flatnonzero(self.used > np.median(self.used))
            size = self.count[kept]
            self.ids = self.ids[np.repeat(self.place[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            self.hashes, self.bytes, self.count, self.used, self.place = self.hashes[kept], self.bytes[kept], size, self.used[kept], np.cumsum(size) - size
        ids, counts = self._encode_units(texts(once))
        self.place = np.append(self.place, len(self.ids) + np.cumsum(counts) - counts)
        self.ids = np.append(self.ids, ids)
        self.hashes, self.bytes = np.append(self.hashes, hashes[once]), np.concatenate([self.bytes, keys[once]])
        self.count, self.used = np.append(self.count, counts), np.append(self.used, np.full(len(once), self.slice))
        self._arrange()

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        self.slice += 1
        raw = LOWER[np.frombuffer(("\n".join(texts) + "\n").encode() + bytes(SHORT), np.uint8)]
        text_bytes = raw[: len(raw) - SHORT]
        begins, ends = pretokens(text_bytes)
        lengths = ends - begins
        eight = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
        keys = np.empty((len(begins), 3), np.uint64)
        hashes = np.zeros(len(begins), np.uint64)
        for k in range(3):
            keys[:, k] = eight[begins + 8 * k] & _MASK[np.clip(lengths - 8 * k, 0, 8)]
            hashes = mix(hashes + keys[:, k])
        data = text_bytes.tobytes()
        read = lambda which: [data[a:b].decode() for a, b in zip(begins[which].tolist(), ends[which].tolist())]
        short = np.flatnonzero(lengths <= SHORT)
        at = np.full(len(begins), -1)
        at[short] = self._find(hashes[short], keys[short])
        new = short[at[short] < 0]
        if len(new):
            self._learn(hashes[new], keys[new], lambda once: read(new[once]))
            at[short] = self._find(hashes[short], keys[short])
        known = np.flatnonzero(at >= 0)
        self.used[at[known]] = self.slice
        place, count = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        place[known], count[known] = self.place[at[known]], self.count[at[known]]
        others = np.flatnonzero(at < 0)
        pool = self.ids
        if len(others):  # long ones, and those whose hash another has
            units, back = np.unique(read(others), return_inverse=True)
            ids, counts = self._encode_units(units.tolist())
            place[others], count[others] = len(pool) + (np.cumsum(counts) - counts)[back], counts[back]
            pool = np.append(pool, ids)
        total = np.cumsum(count)
        ids = pool[np.repeat(place - (total - count), count) + np.arange(total[-1] if len(total) else 0)].astype("<u4").tobytes()
        stops = np.flatnonzero(text_bytes == ord("\n")) if not any("\n" in t for t in texts) else np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
        ids_before = np.append(0, total)[np.searchsorted(begins, stops)] * 4
        return [ids[a:b] for a, b in zip([0, *ids_before.tolist()], ids_before.tolist())]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        plain = [k for k, t in enumerate(texts) if "<|" not in t and PLAIN.fullmatch(t)]
        if plain:
            for k, packed in zip(plain, self._encode_plain([texts[k] for k in plain])):
                out[k] = packed
        odd = [k for k, t in enumerate(texts) if "<|" in t or not PLAIN.fullmatch(t)]
        for k, made in zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = array("I", made.ids).tobytes()
        return out


_CACHES: dict[str, UnitCache] = {}


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each text's ids and one END_ID. Null texts count as empty."""

    def run(batches):
        if path not in _CACHES:
            _CACHES[path] = UnitCache(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, 1, 4000, 1 << 23):
                which, rows = [], []
                for k, packed in enumerate(_CACHES[path].encode_many([t or "" for t in part.column(1).to_pylist()])):
                    packed += end
                    for n, a in enumerate(range(0, len(packed), 4 * limit)):
                        some = packed[a : a + 4 * limit]
                        which.append(k)
                        rows.append((n, a // 4, len(some) // 4, zlib.crc32(some)))
                columns = list(zip(*rows))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *map(pa.array, columns, kinds)], names=[doc_id, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(lengths: list[int], items: list[int], bins: Bins, limit: int) -> Bins:
    """bins with the items added in their order, each to the fullest bin with room."""
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, bin_ in enumerate(bins):
        room = limit - sum([lengths[i] for i in bin_])
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    for i in items:
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = limit, len(bins)
            bins.append([i])
        by_room.setdefault(room - n, []).append(b)
        rooms |= 1 << (room - n)
    return bins


def longest_first(lengths: list[int], items) -> list[int]:
    return sorted(items, key=lengths.__getitem__, reverse=True)


def cost(lengths: list[int], bins: Bins, limit: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with less even fills."""
    return len(bins), -sum((sum(lengths[i] for i in b) / limit) ** 2 for b in bins)


def crossover(lengths: list[int], giver: Bins, taker: Bins, limit: int, rng: random.Random) -> Bins:
    """The giver's well-filled bins whole, the taker's bins that share no piece with them, and best fit for what is displaced."""
    fills = [sum([lengths[i] for i in b]) for b in giver]
    good = sorted(range(len(giver)), key=fills.__getitem__, reverse=True)[: max(1, 2 * len(giver) // 3)]
    injected = [giver[b] for b in good if rng.random() < 0.7]
    have = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in taker:
        if have.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in have]
    return best_fit(lengths, longest_first(lengths, displaced), [list(b) for b in injected] + kept, limit)


def mutate(lengths: list[int], bins: Bins, limit: int, rng: random.Random) -> Bins:
    """Empties the least filled bins and some others, and puts their pieces back."""
    order = sorted(range(len(bins)), key=lambda b: sum([lengths[i] for i in bins[b]]))
    out = set(order[:2]) | {b for b in order if rng.random() < 0.05}
    loose = [i for b in sorted(out) for i in bins[b]]
    return best_fit(lengths, longest_first(lengths, loose), [list(b) for k, b in enumerate(bins) if k not in out], limit)


def evolve(lengths: list[int], population: list[Bins], limit: int, seed: int, longest: bool = False) -> tuple[list[Bins], int]:
    """The population after GENERATIONS more, best first, and how many children of crossovers entered it.

    A new population is best fit of the pieces in random orders. With longest it also holds best fit from the longest to the
    shortest, so what comes out is never worse than that; without, it keeps more different solutions to cross.
    """
    rng = random.Random(seed)
    least = -(-sum(lengths) // limit)
    order = list(range(len(lengths)))
    population = list(population)
    if longest and not population:
        population.append(best_fit(lengths, longest_first(lengths, order), [], limit))
    while len(population) < POPULATION:
        rng.shuffle(order)
        population.append(best_fit(lengths, order, [], limit))
    ranked = sorted(((cost(lengths, p, limit), k, p) for k, p in enumerate(population)))
    accepted = 0
    for generation in range(GENERATIONS):
        if ranked[0][0][0] <= least:
            break
        born = []
        for child in range(POPULATION):
            a, b = rng.sample(range(len(ranked)), 2)
            made = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], limit, rng)
            if rng.random() < 0.6:
                made = mutate(lengths, made, limit, rng)
            born.append((cost(lengths, made, limit), POPULATION * (generation + 2) + child, made))
        ranked = sorted(ranked + born)[:POPULATION]
        accepted += sum(x in ranked for x in born)
    return [p for _, _, p in ranked[:POPULATION]], accepted


def _freeze(bins: Bins, n: int) -> bytes:
    place = array("i", bytes(4 * n))
    for b, items in enumerate(bins):
        for i in items:
            place[i] = b
    return place.tobytes()


def _thaw(data: bytes) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(array("i", data)):
        bins.setdefault(b, []).append(i)
    return [bins[b] for b in sorted(bins)]


def _round(islands: DataFrame, number: int, limit: int) -> DataFrame:
    """Each island's population after another round, the migrant taken in."""

    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            people, costs, fills, entered = [], [], [], []
            for shard, island, lengths, population, migrant, accepted in zip(x["shard"], x["island"], x["lengths"], x["population"], x["migrant"], x["accepted"]):
                start = [_thaw(p) for p in [*population, *([migrant] if migrant is not None else [])]]
                ranked, more = evolve(lengths, start, limit, shard * 1009 + island * 31 + number, island == 0)
                people.append([_freeze(p, len(lengths)) for p in ranked])
                n, fill = cost(lengths, ranked[0], limit)
                costs.append(n)
                fills.append(fill)
                entered.append(accepted + more)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "island", "rows", "lengths")]
            made = [pa.array(people, pa.list_(pa.binary())), pa.array(costs, pa.int32()), pa.array(fills, pa.float64()), pa.array(entered, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["shard", "island", "rows", "lengths", "population", "bins", "fill", "accepted"])

    return islands.mapInArrow(run, "shard long, island int, rows array<long>, lengths array<int>, population array<binary>, bins int, fill double, accepted int")


def _places(best: DataFrame, limit: int) -> DataFrame:
    """packed_row, sequence_id, offset, length, fill (of its bin, 0 to 1) of every piece."""

    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            for shard, rows, lengths, solution in zip(x["shard"], x["rows"], x["lengths"], x["solution"]):
                used: dict[int, int] = {}
                offsets = []
                bins = array("i", solution)
                for b, n in zip(bins, lengths):
                    offsets.append(used.get(b, 0))
                    used[b] = offsets[-1] + n
                ids = np.frombuffer(bins, np.int32).astype(np.int64) + shard * (SHARD * 8)
                fill = [used[b] / limit for b in bins]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32()), pa.array(fill, pa.float64())], names=["packed_row", "sequence_id", "offset", "length", "fill"])

    return best.mapInArrow(run, "packed_row long, sequence_id long, offset long, length int, fill double")


def evolved_islands(small: DataFrame, limit: int) -> DataFrame:
    """The islands of a written table packed_row, length after all rounds, one row each with its population and the number of
    accepted crossovers."""
    shards = -(-small.count() // SHARD) or 1
    dealt = small.select(F.pmod(F.xxhash64("packed_row"), F.lit(shards)).alias("shard"), F.struct(F.col("packed_row"), F.col("length").cast("int").alias("length")).alias("x"))
    gathered = dealt.groupBy("shard").agg(F.array_sort(F.collect_list("x")).alias("x"))  # about SHARD pieces each, by a uniform hash
    islands = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.packed_row").alias("rows"), F.col("x.length").alias("lengths"))
    islands = islands.repartition("shard", "island").withColumn("population", F.array().cast("array<binary>")).withColumn("migrant", F.lit(None).cast("binary")).withColumn("accepted", F.lit(0))
    for number in range(ROUNDS):
        evolved = materialise(_round(islands, number, limit), "islands")
        elite = evolved.select(F.col("shard").alias("to_shard"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("to_island"), F.element_at("population", 1).alias("migrant"))
        islands = evolved.join(elite.hint("merge"), (F.col("shard") == F.col("to_shard")) & (F.col("island") == F.col("to_island"))).drop("to_shard", "to_island")
    return evolved


def _packed(small: DataFrame, limit: int, name: str) -> DataFrame:
    key = F.struct("bins", "fill", "island")
    best = evolved_islands(small, limit).groupBy("shard").agg(F.min_by(F.struct("rows", "lengths", F.element_at("population", 1).alias("solution")), key).alias("b"))
    return materialise(_places(best.select("shard", "b.*"), limit), name)


def pack(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """table (a written one, with a column length of 1 to limit) with sequence_id and offset; an empty table stays empty."""
    numbered = materialise(table.withColumn("packed_row", F.monotonically_increasing_id()), "pieces")
    small = numbered.where(F.col("length") < limit)
    told = lambda df, k: df.select("packed_row", ((LEVELS + 1) * F.col("sequence_id") + k).alias("sequence_id"), "offset")
    level, rest, places = 0, small.select("packed_row", "length"), []
    while True:  # the tails of all shards meet, in ever fewer shards, until those of one shard are left
        made = _packed(rest, limit, f"places-{level}")
        counts = made.agg(F.count("*").alias("n"), *[F.count_if(F.col("fill") < t).alias(f"t{k}") for k, t in enumerate(TAIL_FILLS)]).head()
        fill = next((t for k, t in enumerate(TAIL_FILLS) if 0 < counts[f"t{k}"] <= counts.n / 2), None)
        if counts.n <= SHARD or fill is None or level == LEVELS - 1:
            places.append(told(made, level))
            break
        places.append(told(made.where(F.col("fill") >= fill), level))
        level, rest = level + 1, made.where(F.col("fill") < fill).select("packed_row", "length")
    places = reduce(DataFrame.union, places)
    full = numbered.where(F.col("length") >= limit).withColumn("sequence_id", (LEVELS + 1) * F.col("packed_row") + LEVELS).withColumn("offset", F.lit(0).cast("long"))
    return small.join(places.hint("merge"), "packed_row").unionByName(full).drop("packed_row")


def best_fit_packing(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of docs.

    An empty or null text is the END_ID alone; rows with null or equal ids are packed each.
    """
    return pack(pieces(docs, path, doc_id, text, limit), limit)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return best_fit_packing(docs, public_tokenizers.path(VOCABULARY))
