"""Fill-in-the-middle transformation with cut places found from memoized chunks.

A rolling hash over the last WINDOW bytes cuts a text into chunks whose borders depend on their content alone, so texts
that share a passage share its chunks. A chunk's summary (units that end in it, characters, whether its last byte ends a
unit) is worked out once and kept under the chunk's bytes; equal bytes, not equal hashes, find it again. Summaries add
up: counts over a text's chunks give its number of units and the chunk in which a cut lies, and only there are unit ends
looked for.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import add_columns, slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW, MEAN, LEAST, MOST = 32, 1 << 11, 1 << 8, 1 << 14
#: Bytes of chunks that a worker remembers.
REMEMBERED = 1 << 26

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the WINDOW bytes up to it; 32 bits, a byte's share is shifted out after WINDOW steps."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each of the joined texts, as places in data: behind bytes whose hash has its top bits clear, at
    least LEAST bytes (so WINDOW lies inside the text) and at most MOST apart."""
    marks = np.flatnonzero(rolling_hash(data) < np.uint32((1 << 32) // MEAN)) + 1 if len(data) else np.zeros(0, np.int64)
    out, begin = [], 0
    for end in ends.tolist():
        own = marks[np.searchsorted(marks, begin) : np.searchsorted(marks, end)]
        gaps = np.diff(own, prepend=begin, append=end)
        if len(own) and gaps.min() >= LEAST and gaps.max() <= MOST:
            out.append(np.append(own, end))
        else:
            cuts, at = [], begin
            while end - at > LEAST:
                k = np.searchsorted(own, at + LEAST)
                at = min(int(own[k]) if k < len(own) else end, at + MOST, end)
                cuts.append(at)
            if at < end or not cuts:
                cuts.append(end)
            out.append(np.array(cuts))
        begin = end
    return out


class Summaries:
    """Counts of chunks by their bytes. A unit ends behind the byte `unit_end`, or with the text."""

    def __init__(self, unit_end: bytes):
        self.unit_end, self.known, self.size = unit_end, {}, 0

    def of(self, chunk: bytes) -> tuple[int, int, bool]:
        """(units that end in the chunk, characters that begin in it, whether its last byte ends a unit)."""
        found = self.known.get(chunk)
        if found is None:
            if self.size > REMEMBERED:
                self.known.clear()
                self.size = 0
            found = chunk.count(self.unit_end), characters(chunk), chunk.endswith(self.unit_end)
            self.known[chunk] = found
            self.size += len(chunk) + 100
        return found


def characters(data: bytes) -> int:
    return len(data) - int(np.count_nonzero(np.frombuffer(data, np.int8) < -64))


def after_units(chunk: bytes, unit_end: bytes, n: int) -> int:
    """The place behind the n-th unit end of a chunk."""
    return int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == unit_end[0])[n - 1]) + 1


def locate(chunks: list[bytes], found: list[tuple[int, int, bool]], cuts: list[int], n: int, unit_end: bytes) -> list[tuple[int, int]]:
    """Bytes and characters before each cut (in units), by adding up the chunks' counts; n: units of the text."""
    units = np.cumsum([f[0] for f in found])
    size, chars = np.cumsum([len(c) for c in chunks]), np.cumsum([f[1] for f in found])
    out = []
    for cut in cuts:
        if cut == 0:
            out.append((0, 0))
        elif cut == n:
            out.append((int(size[-1]), int(chars[-1])))
        else:
            k = int(np.searchsorted(units, cut))
            inside = after_units(chunks[k], unit_end, cut - int(units[k] - found[k][0]))
            out.append((int(size[k]) - len(chunks[k]) + inside, int(chars[k]) - found[k][1] + characters(chunks[k][:inside])))
    return out


_MEMORY: dict[bytes, Summaries] = {}


def transformed(ids: list, texts: list[bytes], seed: int, rate: int, spm_rate: int, unit_end: bytes) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output as UTF-8) of each text."""
    memory = _MEMORY.setdefault(unit_end, Summaries(unit_end))
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    out = []
    for i, text, stop, places in zip(ids, texts, ends.tolist(), chunk_ends(np.frombuffer(joined, np.uint8), ends)):
        edges = [0, *(places - (stop - len(text))).tolist()]
        chunks = [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]
        found = [memory.of(c) for c in chunks]
        n = sum(f[0] for f in found) + (bool(found) and not found[-1][2])
        h = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16])
        if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
            out.append((n, "plain", None, None, text))
            continue
        (a, left), (b, upto) = locate(chunks, found, sorted((h[0] % (n + 1), h[1] % (n + 1))), n, unit_end)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        if h[3] % 100 < spm_rate:
            out.append((n, "spm", left, upto - left, b"".join((s, suffix, p, prefix, m, middle))))
        else:
            out.append((n, "psm", left, upto - left, b"".join((p, prefix, s, suffix, m, middle))))
    return out


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, unit_end: str = "\n", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output (string).

    Cuts and forms follow from seed and id alone: rate of 100 texts are transformed, spm_rate of 100 of those as spm. unit_end is
    one ASCII character; units end behind it or with the text. Null texts are empty; empty texts and those that hold a marker
    stay plain; rows with equal ids are cut alike, a null id counts as an empty one. Columns of docs with an added name are replaced.
    """
    end = unit_end.encode("ascii")
    if len(end) != 1:
        raise ValueError("unit_end must be one ASCII character")

    def run(ids: pa.Array, column: pa.Array) -> list:
        rows = []
        for part in slices(pa.RecordBatch.from_arrays([ids, column], names=["i", "t"]), 1):
            rows += transformed(part.column(0).to_pylist(), utf8(part.column(1)), seed, rate, spm_rate, end)
        columns = list(zip(*rows)) if rows else [[]] * 5
        return [*columns[:4], pa.array(columns[4], pa.binary()).cast(pa.string())]

    return add_columns(docs, [doc_id, text], run, "n long, form string, prefix_chars long, middle_chars long, output string", drop)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    made = fill_in_middle(docs, drop=("text",))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
