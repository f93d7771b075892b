"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of all new pre-tokens of a batch form linked lists in one array. Each neighbour pair with a merge waits in
the bucket of its rank, which holds positions of the lists; a three-level bitmap with 64 bits a word knows which
buckets hold something, so the next rank is three find-first-set steps away, whatever the length of a pre-token.
A bucket is merged in one vectorised step for all lists; entries whose pair has changed since are skipped.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tracelink.llm.common import add_columns, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PARTS, CACHE_LENGTH = 500_000, 100
#: Bytes of new pre-tokens that are merged together (a longer pre-token goes alone).
MERGE_BYTES = 4_000_000
SLICE, SLICE_BYTES = 4000, 1 << 24


class RankQueue:
    """Arrays of positions by rank, the least rank first; ranks below 64 ** 3."""

    def __init__(self):
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *edges.tolist(), len(ranks)]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                self.push(int(ranks[a]), positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank with its positions in order, repeats left out."""
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        mid = self.mid[block]
        word = block << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        bucket = self.buckets.pop(rank)
        low &= low - 1
        self.low[word] = low
        if not low:
            mid &= mid - 1
            self.mid[block] = mid
            if not mid:
                self.top = top & (top - 1)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens, which are also their ids: from a rank file, or from a .json file of byte-level BPE without its special tokens."""
    if not path.endswith(".json"):
        with open(path, "rb") as file:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    special, vocabulary, byte = {t["content"] for t in rules["added_tokens"]}, rules["model"]["vocab"], byte_level_alphabet()
    split = rules["pre_tokenizer"]
    if rules["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
        raise ValueError(f"{path} is not plain byte-level BPE")
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in rules["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"the merges of {path} are not in the order of its ids")
    return {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}


class Codec:
    """Encodes and decodes by a rank file; parts of texts are cached packed (little-endian 32-bit ids)."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        keys, merged = [], []
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
            for i in range(1, len(piece)):
                left, right = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        #: tokens that are part of a merge of a lesser rank: their merges must be made one at a time in a pre-token
        parts = np.concatenate([self.keys >> 32, self.keys & 0xFFFFFFFF])
        self.odd = set(parts[parts > np.concatenate([self.merged, self.merged])].tolist())
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(-1))

    def _before_lesser(self, rank: int, at: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places up to the first in each pre-token whose merge gives a pair of a lesser rank, which must come next; and the others."""
        this = np.full(len(at), rank)
        left, right = before[at], after[after[at]]
        none = len(after) - 1
        least = np.full(len(at), 1 << 30)
        for a, b, there in ((token[left], this, left < none), (this, this, left < none), (this, token[right], right < none)):
            made = self._rank(a, b)
            least = np.where(there & (made >= 0), np.minimum(least, made), least)
        own = np.searchsorted(ends, at, side="right")
        if (least >= rank).all():
            return at, at[:0]
        risky = np.cumsum(least < rank)
        begins = np.append(True, own[1:] != own[:-1])
        base = (risky - (least < rank))[begins][np.cumsum(begins) - 1]
        now = risky - (least < rank) == base
        return at[now], at[~now]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        # one place more at the end stands for "none"
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - lengths] = n, n
        token = np.append(token, -1)
        pair = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self._rank(token[inner], token[after[inner]])
        queue = RankQueue()
        at = np.flatnonzero(pair >= 0)
        queue.push_all(pair[at], at)
        alive = np.ones(n, bool)
        while (entry := queue.pop()) is not None:
            rank, at = entry
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if rank in self.odd:
                at, later = self._before_lesser(rank, at, token, after, before, ends)
                if len(later):
                    queue.push(rank, later)
            if len(at) > 1 and (pair[after[at]] == rank).any():  # runs such as aaa: every second place from the left
                taken, last = [], -1
                for x in at.tolist():
                    if x != last:
                        taken.append(x)
                        last = int(after[x])
                    else:
                        last = -1
                at = np.array(taken)
            gone = after[at]
            follow = after[gone]
            token[at] = rank
            after[at], before[follow] = follow, at
            alive[gone] = False
            pair[gone] = -1
            left = before[at]
            left = left[left < n]
            places = np.concatenate([at, left])
            fresh = self._rank(token[places], token[after[places]])
            fresh[after[places] >= n] = -1
            pair[places] = fresh
            some = fresh >= 0
            if some.any():
                queue.push_all(fresh[some], places[some])
        ids = token[:n][alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64)
        stops = (4 * np.cumsum(counts)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens."""
        if len(self.pieces) > CACHE_PARTS:
            self.pieces.clear()
        out = {p: self.pieces[p] for p in pieces if p in self.pieces}
        todo, raw, size = [], [], 0
        pack = lambda rank: rank.to_bytes(4, "little")
        for piece in pieces.difference(out):
            data = piece.encode("utf-8", "surrogatepass")
            if data in self.ranks:
                out[piece] = pack(self.ranks[data])
                continue
            if size and size + len(data) > MERGE_BYTES:
                out.update(zip(todo, self.merge(raw)))
                todo, raw, size = [], [], 0
            todo.append(piece)
            raw.append(data)
            size += len(data)
        if todo:
            out.update(zip(todo, self.merge(raw)))
        self.pieces.update((p, x) for p, x in out.items() if len(p) <= CACHE_LENGTH)
        return out

    @staticmethod
    def _own(part: str) -> str | None:
        """What a part between two cuts stands for; one that follows a line end starts with that mark. None: a cut was no token border."""
        own, head = (part[1:], part[1:2]) if part[0] == "\n" else (" " + part, part[0])
        if head.isspace() and head != "\n" or len(own) > 1 and own[-1] == "\n" and own[-2].isspace():
            return None
        return own

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. The pre-tokens' borders include every space before a word and every single line end
        between words, so texts are cut there and the parts looked up; texts with other runs of white space are matched whole."""
        if len(self.cache) > CACHE_PARTS:
            self.cache.clear()
        cut, wanted = [], {}  # parts of each text (None: matched whole), own text of new parts
        for text in texts:
            parts = None
            if text and not ("  " in text or "\n\n" in text or " \n" in text or text[-1] == " "):
                parts = ("\n" + text.replace("\n", "\n \n")).split(" ")
                if text[0] == " ":
                    del parts[0]
                for part in set(parts).difference(self.cache):
                    if part not in wanted:
                        own = self._own(part)
                        if own is None:
                            parts = None
                            break
                        wanted[part] = own
            cut.append(parts)
        pieces = {part: self.split(own) for part, own in wanted.items()}
        whole = {i: self.split(t) for i, t in enumerate(texts) if cut[i] is None and t}
        known = self._learn({p for group in (pieces, whole) for x in group.values() for p in x})
        made = {part: known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for part, x in pieces.items()}
        cache = self.cache
        long = {p: v for p, v in made.items() if len(p) > CACHE_LENGTH}
        cache.update(made)
        out = []
        for i, parts in enumerate(cut):
            out.append(b"".join(map(cache.__getitem__, parts)) if parts is not None else b"".join([known[p] for p in whole.get(i, ())]))
        for part in long:
            del cache[part]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", packed)))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process; the path must exist on every worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded_slices(column, path: str):
    """Packed ids of a string column's texts, a bounded slice of it at a time."""
    for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0, SLICE, SLICE_BYTES):
        yield from codec(path).encode_many([t or "" for t in part.column(0).to_pylist()])


def encode(docs: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with ids (array of int), the text's ids without special tokens; null texts count as empty, with no ids."""
    return add_columns(docs, [text], lambda c: [[list(array("I", x)) for x in encoded_slices(c, path)]], "ids array<int>", drop)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded (binary), the bytes that the ids stand for; null ids count as none."""
    return add_columns(encoded, [ids], lambda c: [[codec(path).decode(array("I", x or []).tobytes()) for x in c.to_pylist()]], "decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_tokens and the SHA-256 of the packed ids and of the bytes decoded from them; one row for each row of docs."""

    def run(column):
        own, rows = codec(path), []
        for packed in encoded_slices(column, path):
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed)).hexdigest()))
        return list(zip(*rows)) if rows else [[]] * 3

    return add_columns(docs, [text], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path(VOCABULARY), drop=("text",))
