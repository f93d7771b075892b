"""Alignment of two tokenizers' tokens of the same texts: which tokens overlap, and where both end together.

Both token sequences of a batch of documents stand on one byte axis. pandas.merge_asof, keyed by document, finds for each
token start the other side's token that covers it; the pairs of both directions together are all overlaps. Byte offsets at
which a token of either side ends cut the tokens into groups.

How many documents hold an id pair linked is counted over the corpus: blocks of documents count their own pairs, Spark sums
the counts, and each block gets back those of its pairs.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.llm.byte_bpe import Codec
from tracelink.llm.common import materialise, scratch_root, slices

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded together, tokens that are joined together, bytes of text whose pairs are counted together.
SLICE, SLICE_BYTES, JOINED, BLOCK = 4000, 1 << 22, 1 << 17, 1 << 22

#: A worker remembers the ids of so many parts of texts of up to so many characters.
CACHE_PARTS, CACHE_LENGTH = 250_000, 60

#: White space, then other characters: a part of a text. No piece of a model that is cut by parts goes on where a part begins.
_parts = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall


class ByteLevel:
    """Left or right tokenizer by a byte-level BPE file (.json). Every text comes back whole; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.sizes = np.array([len(p) for p in self.codec.bytes_of], np.int64)

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids (32 bits each) of texts that begin with a space."""
        return self.codec.encode_many(texts)


class SentencePieces:
    """The same by a sentencepiece model that puts a space before each text; None for texts that its pieces don't give back."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = [re.fullmatch(r"<0x([0-9A-F]{2})>", n) for n in names]
        self.pieces = [bytes([int(m[1], 16)]) if m else n.replace("▁", " ").encode() for n, m in zip(names, raw)]
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        rules = spec.normalizer_spec
        if not rules.add_dummy_prefix:
            raise ValueError(f"{path} does not put a space before a text")
        plain = rules.name == "identity" and not rules.remove_extra_whitespaces
        self.by_parts = plain and not any("▁" in n.lstrip("▁") or "\n" in n for n in names)
        self.known: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes | None]:
        """Texts begin with a space, or with a line end; then the model's own space is a piece of its own and left out."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        out: list[bytes | None] = []
        for t, x in zip(texts, ids):
            if t[0] != " ":
                del x[0]
            out.append(array("I", x).tobytes() if b"".join(map(self.pieces.__getitem__, x)) == t.encode("utf-8", "surrogatepass") else None)
        return out

    def ids(self, texts: list[str]) -> list[bytes | None]:
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        known = self.known
        cut = [_parts(t) if self.by_parts and "▁" not in t else None for t in texts]
        new = list(set().union(*[p for p in cut if p]).difference(known))
        known.update(zip(new, self._whole(new)))
        out: list[bytes | None] = []
        for p in cut:
            found = list(map(known.__getitem__, p)) if p else [None]
            out.append(None if None in found else b"".join(found))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = x
        for p in new:
            if len(p) > CACHE_LENGTH:
                del known[p]
        return out


Side = ByteLevel | SentencePieces
_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    """One for each worker process; the path must exist on every worker."""
    if path not in _SIDES:
        _SIDES[path] = (ByteLevel if path.endswith(".json") else SentencePieces)(path)
    return _SIDES[path]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b): all pairs of tokens of one document whose bytes overlap. Frames have doc, start (both ascending) and token."""
    left, right = a.rename(columns={"token": "a"}), b.rename(columns={"token": "b"})
    pairs = [pd.merge_asof(x, y, on="start", by="doc") for x, y in ((left, right), (right, left))]
    # a start that both have is found from both sides
    both = np.isin(right["start"].to_numpy(), left["start"].to_numpy(), assume_unique=True)
    return pd.concat([pairs[0][["a", "b"]], pairs[1].loc[~both, ["a", "b"]]], ignore_index=True)


def _written(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], stops: list[np.ndarray], names: list[bytes], kinds: int) -> list[bytes]:
    """For each document a1,a2|b1;a3|b2,b3: the decimal ids of each group's tokens. names: those of the left ids with a comma, a bar
    and a semicolon behind, then those of the right ones; kinds: the number of left ids. stops: the documents' first tokens."""
    group = np.concatenate([2 * groups[0], 2 * groups[1] + 1])
    order = np.argsort(group, kind="stable")
    group = group[order]
    mark = np.full(len(group), 2)
    mark[:-1] = np.where(group[1:] == group[:-1], 0, np.where(group[1:] & 1, 1, 2))
    size = np.where(group & 1, (len(names) - 3 * kinds) // 3, kinds)
    at = (mark * size + np.concatenate(ids)[order] + np.where(group & 1, 3 * kinds, 0)).tolist()
    edges = (stops[0] + stops[1]).tolist()
    return [b"".join(map(names.__getitem__, at[a:b]))[:-1] for a, b in zip(edges, edges[1:])]


def aligned(texts: list[str], left: Side, right: Side):
    """For each text its left tokens, right tokens, groups, linked ids (left << 32 | right, one for each link) and written groups.

    Texts are encoded together and joined a bounded number of tokens at a time.
    """
    spaced = [" " + t for t in texts]
    found = [side.ids(spaced) for side in (left, right)]
    kept = [(x, y) if t and x is not None and y is not None else (b"", b"") for t, x, y in zip(texts, *found)]
    begin, size = 0, 0
    for k, (x, y) in enumerate(kept):
        if k > begin and size + len(x) + len(y) > 8 * JOINED:
            yield from _joined(kept[begin:k], left, right)
            begin, size = k, 0
        size += len(x) + len(y)
    yield from _joined(kept[begin:], left, right)


def _joined(kept: list[tuple[bytes, bytes]], left: Side, right: Side) -> list[tuple[int, int, int, np.ndarray, bytes]]:
    """aligned() from the packed ids of both sides."""
    ids = [np.frombuffer(b"".join(k), np.uint32).astype(np.int64) for k in zip(*kept)]
    stops = [np.cumsum([0, *[len(x) // 4 for x in k]]) for k in zip(*kept)]
    docs = [np.repeat(np.arange(len(kept)), np.diff(s)) for s in stops]
    ends = [np.cumsum(s.sizes[i]) for s, i in zip((left, right), ids)]
    starts = [e - s.sizes[i] for e, s, i in zip(ends, (left, right), ids)]
    common = np.intersect1d(*ends, assume_unique=True)
    groups = [np.searchsorted(common, e) for e in ends]
    # a long document is cut where both sides end
    pairs, begin = [], [0, 0]
    while begin[0] < len(ids[0]):
        stop = common[groups[0][min(begin[0] + JOINED, len(ids[0]) - 1)]]
        upto = [int(np.searchsorted(e, stop, side="right")) for e in ends]
        frames = [pd.DataFrame({"doc": docs[k][begin[k] : upto[k]], "start": starts[k][begin[k] : upto[k]], "token": np.arange(begin[k], upto[k])}) for k in (0, 1)]
        pairs.append(overlaps(*frames))
        begin = upto
    a, b = (np.concatenate([p[c].to_numpy(np.int64) for p in pairs]) if pairs else np.zeros(0, np.int64) for c in ("a", "b"))
    order = np.argsort(docs[0][a], kind="stable")
    keys = ids[0][a[order]] << 32 | ids[1][b[order]]
    edges = np.searchsorted(docs[0][a[order]], np.arange(len(kept) + 1))
    before = np.append(0, ends[0])[stops[0]]
    counts = np.diff(np.searchsorted(common, before, side="right"))
    told = _written(tuple(ids), tuple(groups), stops, names(left, right), len(left.sizes))
    return [(int(stops[0][k + 1] - stops[0][k]), int(stops[1][k + 1] - stops[1][k]), int(counts[k]), keys[edges[k] : edges[k + 1]], told[k]) for k in range(len(kept))]


_NAMES: dict[tuple[int, int], list[bytes]] = {}


def names(left: Side, right: Side) -> list[bytes]:
    """What _written() puts together."""
    key = len(left.sizes), len(right.sizes)
    if key not in _NAMES:
        _NAMES[key] = [f"{i}{mark}".encode() for n in key for mark in ",|;" for i in range(n)]
    return _NAMES[key]


ROWS = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked binary, times binary, pairs array<struct<a:int,b:int,docs:long>>"


def _align(left_path: str, right_path: str, block_bytes: int):
    """Rows of (doc_id, text) to ROWS. linked: places of a document's different pairs in its block's list, which the block's row
    0 carries behind the others' with the number of documents that hold each; times: how often the document links each."""

    def run(batches):
        left, right = side(left_path), side(right_path)
        part, number, rows, size, seen = TaskContext.get().partitionId(), 0, [], 0, []

        def flush():
            nonlocal rows, size, seen, number
            block, number = part << 32 | number, number + 1
            found, place, docs = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
            cuts = np.cumsum([len(s) for s in seen])
            linked = [place[b - len(s) : b].astype(np.uint32).tobytes() for s, b in zip(seen, cuts)]
            pairs = pa.StructArray.from_arrays([pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(docs.astype(np.int64))], names=["a", "b", "docs"])
            listed = pa.ListArray.from_arrays(pa.array([0, *[len(found)] * len(rows)], pa.int32()), pairs)
            columns = [pa.array([block] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32())]
            columns += [pa.array(c, t) for c, t in zip(list(zip(*rows))[:6], (*[pa.int64()] * 5, pa.string()))]
            columns += [pa.array(linked, pa.binary()), pa.array([r[6] for r in rows], pa.binary()), listed]
            rows, size, seen = [], 0, []
            return pa.RecordBatch.from_arrays(columns, names=["block", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked", "times", "pairs"])

        for batch in batches:
            for piece in slices(batch, 1, SLICE, min(SLICE_BYTES, block_bytes)):
                ids, texts = piece.column(0).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
                for i, text, (n_a, n_b, n_groups, keys, told) in zip(ids, texts, aligned(texts, left, right)):
                    different, times = np.unique(keys, return_counts=True)
                    digest = hashlib.sha256(told).hexdigest() if n_a else ""
                    rows.append((i, n_a, n_b, n_groups, len(keys), digest, times.astype(np.uint32).tobytes()))
                    seen.append(different)
                    size += len(text)
                if size >= block_bytes:
                    yield flush()
        if rows:
            yield flush()

    return run


def _counted(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """n_best and count_sum of each document of a block, from the corpus-wide counts of the block's pairs."""
    counts = counts.sort_by("place")
    count, best = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    n_best, total = [], []
    for linked, times in zip(rows.column("linked").to_pylist(), rows.column("times").to_pylist()):
        at, n = np.frombuffer(linked, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
        n_best.append(int(n[best[at]].sum()) if len(at) else 0)
        total.append(int((n * count[at]).sum()) if len(at) else 0)
    kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", rows.column("groups_sha256"))


def align(docs: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_a and n_b (tokens of the left and right tokenizer of space + text), n_groups, n_links,
    n_best (links whose pair is held by as many documents as any pair of its left id), count_sum (documents that hold each link's
    pair, added up) and groups_sha256 (of the groups as text, see _written()).

    left and right are tokenizer files: .json for byte-level BPE, .model for sentencepiece. Texts that are null, empty, or that a
    tokenizer doesn't give back byte by byte have no tokens: zeros and an empty groups_sha256. Rows that repeat an id or text count
    as documents of their own. block_bytes: text whose pairs are counted together, which changes no result. Columns of docs but these two do not matter and are not returned.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path = f"{scratch_root(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(_align(left, right, block_bytes), ROWS).write.parquet(path)
    table = docs.sparkSession.read.schema(ROWS).parquet(path)
    own = table.where("row = 0").select("block", F.posexplode("pairs").alias("place", "p")).select("block", "place", "p.*")
    held = own.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    ranked = held.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    counts = own.select("block", "place", "a", "b").join(ranked.hint("merge"), ["a", "b"]).select("block", "place", "count", "best")
    counts = materialise(counts, "aligned-counts")
    return table.drop("pairs").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT))
