"""Unigram token counts by dynamic programming over a trie of the distinct pre-tokens.

The new pre-tokens of a slice are sorted, which lays out their trie: a cell (row, depth) is a node where its prefix is not
the row's before. Pieces that end at a node are looked up once for it, by hash and then by their characters, whatever the
pre-token's length. The forward score of a node (the best sum of log probabilities of pieces that spell the prefix, and how
many pieces that takes) follows depth by depth, for all nodes of a depth at once, from its ancestors' scores; a
pre-token's count is its terminal node's. Texts then only look their pre-tokens up, so the work needs no shuffle and
grows with the input.

Pieces and their order come from a public vocabulary file; a piece's probability falls with its rank (1 / (rank + 1)).
Characters that no piece covers cost PENALTY below the least piece and count as their UTF-8 bytes.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tracelink.llm.common import add_columns, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0
#: Pre-tokens held, and cells (pre-tokens times their greatest length) of one trie.
CACHE_WORDS, CELLS = 500_000, 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))


def _mix(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Unigram:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        total = math.log(sum(1 / (i + 1) for i in range(size)))
        self.scores: dict[str, float] = {}
        for i in range(size):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores.setdefault(model.id_to_piece(i), -math.log(i + 1) - total)
        self.unknown = min(self.scores.values()) - PENALTY
        self.longest = max(map(len, self.scores))
        pieces = list(self.scores)
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.codes = np.zeros((len(pieces), self.longest), np.uint32)
        self.codes[np.arange(self.longest) < self.sizes[:, None]] = _codes("".join(pieces))
        self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(self.longest, _M))])
        inside = np.where(np.arange(self.longest) < self.sizes[:, None], _mix(self.codes) * self.power[: self.longest], np.uint64(0))
        hashes = inside.sum(1, dtype=np.uint64) + self.power[self.sizes]
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], self.codes[order]
        self.values = np.fromiter(self.scores.values(), float, len(pieces))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.words: dict[str, tuple[int, float]] = {}

    def _pieces_at(self, code: np.ndarray, sums: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes (row, depth) and the pieces that end there: the node's number, the piece's length, its score."""
        out = []
        back = np.multiply.accumulate(np.full(sums.shape[1], _INVERSE)) * _M  # powers that undo a place's own
        for n in range(1, self.longest + 1):
            some = np.flatnonzero(depth >= n)
            start = depth[some] - n
            hashes = (sums[row[some], depth[some]] - sums[row[some], start]) * back[start] + self.power[n]
            hit = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[hit]
            hit, at = hit[same], at[same]
            spelt = code[row[some[hit]][:, None], start[hit][:, None] + np.arange(n)]
            same = (spelt == self.codes[at, :n]).all(1)
            out.append((some[hit[same]], np.full(int(same.sum()), n), self.values[at[same]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def many(self, words: list[str]) -> list[tuple[int, float]]:
        """Counts and scores of sorted distinct pre-tokens."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        deep = int(lengths.max())
        inside = np.arange(deep) < lengths[:, None]
        code = np.zeros((len(words), deep), np.uint32)
        code[inside] = _codes("".join(words))
        new = inside.copy()
        new[1:] &= ~np.logical_and.accumulate((code[1:] == code[:-1]) & inside[:-1], axis=1)
        owner = np.maximum.accumulate(np.where(new, np.arange(len(words), dtype=np.int32)[:, None], 0), axis=0)
        sums = np.zeros((len(words), deep + 1), np.uint64)
        np.cumsum(_mix(code) * (np.multiply.accumulate(np.full(deep, _M)) * _INVERSE), axis=1, out=sums[:, 1:])
        depth, row = np.nonzero(new.T)  # nodes, depth by depth
        depth += 1
        n_nodes = len(row)
        number = np.full((len(words), deep + 1), n_nodes, np.int64)  # the root has the last number
        number[row, depth] = np.arange(n_nodes)
        node, size, value = self._pieces_at(code, sums, row, depth)
        c = code[row, depth - 1]
        node = np.concatenate([np.arange(n_nodes), node])
        size = np.concatenate([np.ones(n_nodes, np.int64), size])
        value = np.concatenate([np.full(n_nodes, self.unknown), value])
        more = np.concatenate([1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), np.ones(len(node) - n_nodes, np.int64)])
        order = np.argsort(node, kind="stable")
        node, size, value, more = node[order], size[order], value[order], more[order]
        above = depth[node] - size
        up = np.where(above > 0, number[owner[row[node], np.maximum(above - 1, 0)], above], n_nodes)
        score, count = np.zeros(n_nodes + 1), np.zeros(n_nodes + 1, np.int64)
        begins = np.searchsorted(node, np.arange(n_nodes + 1))
        levels = np.searchsorted(depth, np.arange(1, deep + 2)).tolist()
        for first, last in zip(levels, levels[1:]):
            a, b = begins[first], begins[last]
            at = begins[first:last] - a
            given = score[up[a:b]] + value[a:b]
            best = np.maximum.reduceat(given, at)
            taken = np.where(given == best[node[a:b] - first], count[up[a:b]] + more[a:b], 1 << 60)
            score[first:last], count[first:last] = best, np.minimum.reduceat(taken, at)
        ends = number[owner[np.arange(len(words)), lengths - 1], lengths]
        return list(zip(count[ends].tolist(), score[ends].tolist()))

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHE_WORDS:
            self.words = {}
        ordered = sorted(words)
        lengths = np.fromiter(map(len, ordered), np.int64, len(ordered)) + 1
        power = np.frexp(np.maximum(lengths, 32).astype(float))[1]  # words of like length together, so that tries are full
        for k in np.unique(power):
            alike = np.flatnonzero(power == k).tolist()
            rows = max(1, CELLS >> int(k))
            for i in range(0, len(alike), rows):
                some = [ordered[x] for x in alike[i : i + rows]]
                self.words.update(zip(some, self.many([MARK + w for w in some])))


_MODELS: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, n_tokens and score (natural log of the best segmentation's probability).

    Pre-tokens are the words between ASCII white space, each with a mark before it. Null and empty texts have zeros.
    Of segmentations with equal scores the shortest counts. One row for each row of docs.
    """

    def run(column):
        if path not in _MODELS:
            _MODELS[path] = Unigram(path)
        model, rows = _MODELS[path], []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0, 2000, 1 << 23):
            split = [(t or "").translate(SPACES).split(" ") for t in part.column(0).to_pylist()]
            wanted = set().union(*split)
            wanted.discard("")
            fresh = wanted.difference(model.words)
            if len(model.words) + len(fresh) > CACHE_WORDS:
                fresh = wanted
            model.learn(fresh)
            for words in split:
                found = [model.words[w] for w in words if w]
                rows.append((len(found), sum(n for n, _ in found), math.fsum(s for _, s in found)))
        return list(zip(*rows)) if rows else [[]] * 3

    return add_columns(docs, [text], run, "n_words long, n_tokens long, score double", drop)


SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY), drop=("text",))
