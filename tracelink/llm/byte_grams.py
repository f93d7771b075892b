"""Counts and log probabilities of byte grams, shared by the language models.

A gram is a symbol (a byte, or the end of a text) with the ORDER symbols before it; contexts run on across white space
and begin with START symbols. Symbols take nine bits, so a gram is one exact 64-bit number and no two grams are ever
mistaken for each other. The probability of a symbol depends on its gram alone. Spark therefore counts the distinct
grams of all texts, a model gives each its log probability, and a text's score is the sum over its places.

The table of grams is a trie over reversed contexts and grows with the corpus. Grams with the same last three context
symbols lie together, so contexts of three symbols and more are complete in one group (at most 258**2 * 257 grams;
about GROUP in practice). Contexts of two symbols and fewer have at most 258**2 * 257 counts in all, whatever the corpus,
and go to every task. The FREQUENT most frequent grams go to every task as a sorted hash array; places with another gram
are few and join the table on it. A gram beyond those has less than one FREQUENT-th of all places, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.common import utf8

ORDER = 5
BITS = 9
END, START, SYMBOLS = 256, 257, 257
FREQUENT = 1 << 20
GROUP = 200_000
#: Bytes of text that are worked on at a time, and distinct grams that a task holds before it sends them on.
SLICE, HELD = 1 << 21, 3_000_000


def low(n: int) -> int:
    """A mask of the last n symbols of a gram."""
    return (1 << BITS * n) - 1


def gram_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All grams of the texts, in slices of about SLICE bytes: grams, where each piece of a text begins among them, its text.

    A longer text is cut to several pieces; each keeps the bytes before it as context. An empty text has its end alone.
    """
    pieces: list[tuple[int, bytes, bool, bool]] = []
    held = 0

    def flush():
        raw = np.frombuffer(b"".join([p[1] if p[2] else bytes(ORDER) + p[1] for p in pieces]), np.uint8).astype(np.int64)
        sizes = np.fromiter((len(p[1]) + (0 if p[2] else ORDER) for p in pieces), np.int64, len(pieces))
        goes_on = np.fromiter((p[2] for p in pieces), bool, len(pieces))
        begins = np.cumsum(sizes) - sizes
        lead = (begins[:, None] + np.arange(ORDER)).ravel()
        raw[lead.reshape(-1, ORDER)[~goes_on].ravel()] = START
        ends = np.cumsum(sizes)[np.fromiter((p[3] for p in pieces), bool, len(pieces))] - 1
        raw[ends] = END
        grams = raw.copy()
        for k in range(1, ORDER + 1):
            grams[k:] |= raw[:-k] << (BITS * k)
        keep = np.ones(len(raw), bool)
        keep[lead] = False
        n = sizes - ORDER
        return grams[keep], np.cumsum(n) - n, np.fromiter((p[0] for p in pieces), np.int64, len(pieces))

    for i, text in enumerate(texts):
        for a in range(0, len(text) + 1, SLICE):
            last = a + SLICE > len(text)
            piece = text[max(a - ORDER, 0) : a + SLICE] + (b"\0" if last else b"")
            pieces.append((i, piece, a > 0, last))
            held += len(piece)
            if held >= SLICE:
                yield flush()
                pieces, held = [], 0
    if pieces:
        yield flush()


def mix(grams: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = grams.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class HashArray:
    """Sorted hashes of grams with their values; the leading bits of a hash tell where to begin to look."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        hashes = mix(grams)
        order = np.argsort(hashes)
        self.hashes, self.values = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(values[order], 0.0)
        self.shift = np.uint64(64 - max(1, len(grams).bit_length() + 1))
        steps = np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hashes, steps).astype(np.int32)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams' values, and which of them are there."""
        hashes = mix(grams)
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        found = self.hashes[at]
        behind = np.flatnonzero(found < hashes)
        while len(behind):
            at[behind] += 1
            found[behind] = self.hashes[at[behind]]
            behind = behind[found[behind] < hashes[behind]]
        return self.values[at], (found == hashes) & (at < len(self.hashes) - 1)


def add_counts(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct grams with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    grams = np.concatenate([p[0] for p in parts])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    begins = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[begins], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], begins) for k in range(1, len(parts[0])))


def count_grams(docs: DataFrame, text, trains, normal: Callable[[bytes], bytes]) -> DataFrame:
    """gram, c (occurrences in the texts that train), n (in all texts). text and trains are columns; null texts are empty."""

    def send(parts):
        grams, c, n = add_counts(parts)
        for i in range(0, len(grams), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (grams, c, n)], names=["gram", "c", "n"])

    def run(batches):
        parts: list = []
        for batch in batches:
            texts = [normal(t) for t in utf8(batch.column(0))]
            learns = batch.column(1).to_pylist()
            for wanted in (True, False):
                for grams, _, _ in gram_slices([t for t, x in zip(texts, learns) if x == wanted]):
                    grams, n = np.unique(grams, return_counts=True)
                    parts.append((grams, n if wanted else np.zeros_like(n), n))
                    if len(parts) >= 16:
                        parts = [add_counts(parts)]
            if parts and sum(len(p[0]) for p in parts) > HELD:
                yield from send(parts)
                parts = []
        if parts:
            yield from send(parts)

    made = docs.select(text.alias("t"), trains.alias("learns")).mapInArrow(run, "gram long, c long, n long")
    return made.groupBy("gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def in_groups(grams: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on groups of a written gram table that hold all grams with the same last three context symbols."""
    groups = -(-grams.count() // GROUP) or 1
    node = F.shiftright("gram", BITS).bitwiseAND(low(3))
    return grams.groupBy(F.pmod(F.xxhash64(node), F.lit(groups))).applyInArrow(fn, schema)


def most_frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of a written table with the greatest n, at most `most` of them: those above a level that a histogram of n finds
    (64 levels for each doubling), so nothing is sorted or gathered."""
    level = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("int")
    sizes = table.where(F.col(n) > 0).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 20
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return table.where((F.col(n) > 0) & (level >= least))


def frequent(scored: DataFrame) -> HashArray:
    """The log probabilities of at most FREQUENT grams, the most frequent, of a written table gram, n, lp."""
    top = most_frequent(scored, "n", FREQUENT).select("gram", F.col("lp").cast("float")).toArrow()
    return HashArray(top.column("gram").to_numpy(), top.column("lp").to_numpy().astype(np.float64))


def text_scores(texts: list[bytes], known: HashArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of known log probabilities of each text; the texts and grams of the other places."""
    sums = np.zeros(len(texts))
    who, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for grams, begins, owners in gram_slices(texts):
        lp, there = known.find(grams)
        lp[~there] = 0.0
        np.add.at(sums, owners, np.add.reduceat(lp, begins))
        odd = np.flatnonzero(~there)
        if len(odd):
            who.append(owners[np.searchsorted(begins, odd, side="right") - 1])
            rest.append(grams[odd])
    return sums, np.concatenate(who), np.concatenate(rest)


def group(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and, for each element, the number of its value."""
    values, back = np.unique(of, return_inverse=True)
    return values, back.ravel()

