"""Similarity of names, a batch of pairs at a time: texts stand as rows of a matrix of code points and all pairs advance together.

The token-set and the weighted ratio rest on the longest common subsequence, whose column of the usual table is kept in the
bits of 64-bit words: one step for each character of the second text, whatever the length of the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of the weighted ratio: for token measures, and for partial ones of texts up to and over eight times as long.
TOKEN_WEIGHT, PARTIAL_WEIGHT, FAR_WEIGHT, PARTIAL_FROM, FAR_FROM = 0.95, 0.9, 0.6, 1.5, 8.0
BATCH = 20_000


def codes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each (0 behind the end), and the lengths."""
    texts = list(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = max(1, int(sizes.max(initial=0)))
    out = np.zeros((len(texts), wide), np.uint32)
    filled = np.arange(wide) < sizes[:, None]
    out[filled] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def common_subsequence(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows."""
    words = -(-a.shape[1] // 64)
    padded = np.zeros((len(a), 64 * words), np.uint32)
    padded[:, : a.shape[1]] = a
    inside = np.arange(64 * words) < a_size[:, None]
    state = [np.full(len(a), ~np.uint64(0)) for _ in range(words)]
    for j in range(int(b_size.max(initial=0))):
        same = (padded == b[:, j : j + 1]) & inside & (j < b_size)[:, None]
        match = np.packbits(same, axis=1, bitorder="little").view("<u8")
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            both = state[w] & match[:, w]
            part = state[w] + both
            total = part + carry
            carry = ((part < both) | (total < part)).astype(np.uint64)
            state[w] = total | (state[w] - both)
    held = np.packbits(inside, axis=1, bitorder="little").view("<u8")
    return sum((np.bitwise_count(~state[w] & held[:, w]).astype(np.int64) for w in range(words)), np.zeros(len(a), np.int64))


def _share(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    """100 for equal texts: twice the common part of both lengths together."""
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def ratio(a, b) -> np.ndarray:
    """0 to 100: twice the longest common subsequence over both lengths."""
    (x, n), (y, m) = codes(a), codes(b)
    return _share(common_subsequence(x, n, y, m), n + m)


def partial_ratio(a, b) -> np.ndarray:
    """The best ratio() of the shorter text with any part of the other that is as long, or that a border cuts."""
    (x, n), (y, m) = codes(a), codes(b)
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
    out = np.where((n == 0) | (m == 0), np.where(n == m, 100.0, 0.0), 0.0)
    # both ways if equally long
    for short, long, k, size, rows in ((x, y, n, m, np.flatnonzero((n <= m) & (n > 0))), (y, x, m, n, np.flatnonzero((m <= n) & (m > 0)))):
        parts = size[rows] + k[rows] - 1
        row = np.repeat(rows, parts)
        end = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        begin, end = np.maximum(end - k[row], 0), np.minimum(end, size[row])
        for s in range(0, len(row), BATCH):
            r, p, q = row[s : s + BATCH], begin[s : s + BATCH], end[s : s + BATCH]
            steps = np.minimum(p[:, None] + np.arange(int((q - p).max())), wide - 1)
            common = common_subsequence(short[r], k[r], np.take_along_axis(long[r], steps, 1), q - p)
            np.maximum.at(out, r, _share(common, k[r] + q - p))
    return out


def token_set(shared, only_a, only_b) -> np.ndarray:
    """The token-set ratio from the sorted words that both have, and those that only one has: 100 if one has all words of the other."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (shared, only_a, only_b)]
    some, gap = sizes[0] > 0, (sizes[0] > 0).astype(np.int64)
    (x, n), (y, m) = codes(only_a), codes(only_b)
    whole = [sizes[0] + gap + k for k in (n, m)]
    apart = n + m - 2 * common_subsequence(x, n, y, m)
    total = whole[0] + whole[1]
    out = np.where(total > 0, 100.0 - 100.0 * apart / np.maximum(total, 1), 0.0)
    for k, w in zip((n, m), whole):
        out = np.where(some, np.maximum(out, 100.0 - 100.0 * (gap + k) / np.maximum(sizes[0] + w, 1)), out)
    empty = (sizes[0] + n == 0) | (sizes[0] + m == 0)
    return np.where(empty, 0.0, np.where(some & ((n == 0) | (m == 0)), 100.0, out))


def weighted(a, b, sorted_a, sorted_b, shared, only_a, only_b) -> np.ndarray:
    """The weighted ratio: of texts of similar length the better of ratio() and the token measures, of others that of the partial ones."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    far = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    out = ratio(a, b)
    near = np.flatnonzero(far < PARTIAL_FROM)
    pick = lambda x, at: [x[i] for i in at.tolist()]
    tokens = np.maximum(ratio(pick(sorted_a, near), pick(sorted_b, near)), token_set(pick(shared, near), pick(only_a, near), pick(only_b, near)))
    out[near] = np.maximum(out[near], TOKEN_WEIGHT * tokens)
    rest = np.flatnonzero(far >= PARTIAL_FROM)
    scale = np.where(far[rest] <= FAR_FROM, PARTIAL_WEIGHT, FAR_WEIGHT)
    part = np.maximum(partial_ratio(pick(sorted_a, rest), pick(sorted_b, rest)), partial_ratio(pick(only_a, rest), pick(only_b, rest)))
    part = np.where([len(s) > 0 for s in pick(shared, rest)], 100.0, part)
    out[rest] = np.maximum(out[rest], scale * np.maximum(partial_ratio(pick(a, rest), pick(b, rest)), TOKEN_WEIGHT * part))
    return np.where((n == 0) | (m == 0), 0.0, out)


def jaro_winkler_of(a, b) -> np.ndarray:
    """0 to 1: Jaro's share of matching characters within half the longer length, raised by a common prefix of up to four."""
    (x, n), (y, m) = codes(a), codes(b)
    rows = np.arange(len(x))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place = np.arange(y.shape[1])
    free, hit = place < m[:, None], np.zeros(x.shape, bool)
    for i in range(int(n.max(initial=0))):
        can = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach) & (i < n)[:, None]
        at = can.argmax(1)
        hit[:, i] = can[rows, at]
        free[rows, at] &= ~hit[:, i]
    taken = (place < m[:, None]) & ~free
    k = hit.sum(1)
    wide = max(1, int(k.max(initial=0)))
    first = lambda z, marked: np.take_along_axis(z, np.argsort(~marked, axis=1, kind="stable")[:, :wide], 1)
    swapped = ((first(x, hit) != first(y, taken)) & (np.arange(wide) < k[:, None])).sum(1) // 2
    jaro = np.where(k > 0, (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - swapped) / np.maximum(k, 1)) / 3, (n + m == 0).astype(float))
    narrow = min(4, x.shape[1], y.shape[1])
    same = (x[:, :narrow] == y[:, :narrow]) & (np.arange(narrow) < np.minimum(n, m)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two texts, 0 to 1; null (in a batch a NaN, which Spark takes for null) if either is null."""
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = jaro_winkler_of(a[there], b[there])
    return pd.Series(out)


@F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in ("token_set", "weighted", "jaro")]))
def _measures(a: pd.Series, b: pd.Series, sorted_a: pd.Series, sorted_b: pd.Series, shared: pd.Series, only_a: pd.Series, only_b: pd.Series) -> pd.DataFrame:
    a, b, sorted_a, sorted_b, shared, only_a, only_b = (x.tolist() for x in (a, b, sorted_a, sorted_b, shared, only_a, only_b))
    return pd.DataFrame({"token_set": token_set(shared, only_a, only_b), "weighted": weighted(a, b, sorted_a, sorted_b, shared, only_a, only_b), "jaro": 100 * jaro_winkler_of(a, b)})


def words(name: Column) -> Column:
    """The words of a name in order."""
    return F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")


def with_name_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with token_set, weighted, jaro and score, the greatest of the three (0 to 100, case counts). Null names are empty ones."""
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    x, y = words(given(a)), words(given(b))
    joined = lambda w: F.array_join(F.array_sort(w), " ")
    parts = [given(a), given(b), joined(x), joined(y), joined(F.array_intersect(x, y)), joined(F.array_except(x, y)), joined(F.array_except(y, x))]
    scored = pairs.withColumn("measures_of_pair", _measures(*parts))
    out = [F.col(f"measures_of_pair.{m}").alias(m) for m in ("token_set", "weighted", "jaro")]
    return scored.select(*pairs.columns, *out).withColumn("score", F.greatest("token_set", "weighted", "jaro"))
