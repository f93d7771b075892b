"""Quality rules: n-gram perplexity under a modified Kneser-Ney model, with bands per language.

The model is over the bytes of a text, its words lower-cased and joined by single blanks, with grams of six symbols that
run on across word borders (byte_grams.py): Spark counts them, the counts of counts and of different left neighbours give
the discounts and the lower orders, and each gram's interpolated probability is worked out once, group by group. Frequent
grams go to every task as a sorted hash array, the others are joined, so the model grows with the corpus and no gram is
left out or mistaken for another.

The bands are [q1 - LOWER * (q3 - q1), q3 + UPPER * (q3 - q1)] of log10 perplexity a word, with the quartiles of each language
over its distinct texts that pass the base rules, so copies and junk do not move them, and q3 - q1 counted as
LEAST_IQR at least; a document outside its language's band is rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.byte_grams import BITS, SYMBOLS, count_grams, frequent, group, in_groups, low, text_scores
from tracelink.llm.common import add_columns, materialise, slices, utf8

SIGNS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Reach of the band below and above the quartiles, in interquartile ranges. Words' log probabilities average out over a
#: document, so ordinary prose lies well within it. Copies and near copies make a text easy to predict without making it
#: bad, so the reach below is the greater.
LOWER, UPPER = 6.0, 3.0
#: Least interquartile range of a band, in log10 perplexity a word, so that a language of few or much alike texts keeps a band.
LEAST_IQR = 0.03
#: Hashes of copied texts that are broadcast at most (8 MB); more of them are joined, with the same result.
BROADCAST_HASHES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """text: each different text once, so that copies do not bend the model to themselves.

    Only texts whose 64-bit hash stands twice are compared and moved; the others are read where they lie.
    """
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    twice = materialise(rows.groupBy("hash").count().where("count > 1").select("hash"), "copied-hashes")
    told = F.broadcast(twice) if twice.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES else twice.hint("merge")
    return rows.join(told, "hash", "left_anti").select("text").union(rows.join(told, "hash", "left_semi").select("text").distinct())


def discounts(of: tuple[int, ...]) -> list[float]:
    """The discounts of counts 0 to 3 or more, from how many grams have the counts 1 to 4."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    return [0.0, *(min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.1 * i), 0.95 * i) if of[i - 1] else 0.5 * i for i in (1, 2, 3))]


def interpolated(grams: np.ndarray, adjusted: np.ndarray, cuts: list[float], lower: np.ndarray) -> np.ndarray:
    """Probabilities of distinct grams from their adjusted counts and the probabilities of their suffixes."""
    contexts, back = group(grams >> BITS)
    cut = np.array(cuts)[np.minimum(adjusted, 3).astype(int)]
    total = np.bincount(back, adjusted, len(contexts))
    weight = np.bincount(back, cut, len(contexts)) / total
    return (adjusted - cut) / total[back] + weight[back] * lower


def left_neighbours(grams: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of n_symbols of distinct grams one symbol longer, and how many of these each has."""
    own, back = group(grams & low(n_symbols))
    return own, np.bincount(back, minlength=len(own))


def _orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length 6, 5 and 4: the distinct grams of a group and their adjusted counts (left neighbours below the longest)."""
    by_gram = np.argsort(grams)
    out = {6: (grams[by_gram], counts[by_gram])}
    for k in (5, 4):
        out[k] = left_neighbours(out[k + 1][0], k)
    return out


def _times(adjusted: np.ndarray) -> np.ndarray:
    return np.bincount(adjusted[adjusted <= 4].astype(int), minlength=5)[1:]


def score_grams(counted: DataFrame) -> DataFrame:
    """gram, n, lp: the modified Kneser-Ney log10 probability of every gram of a written count table gram, c, n (c > 0)."""
    spark = counted.sparkSession

    def shapes(part: pa.Table) -> pa.Table:
        """ord, key, n: by length how many grams have the count key (1 to 4); for length 3 the left neighbours of the gram key."""
        rows = []
        orders = _orders(part.column("gram").to_numpy(), part.column("c").to_numpy())
        for k, (_, adjusted) in orders.items():
            rows.append((np.full(4, k), np.arange(1, 5), _times(adjusted)))
        own, n = left_neighbours(orders[4][0], 3)
        rows.append((np.full(len(own), 3), own, n))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows)], names=["ord", "key", "n"])

    # at most 258**2 * 257 grams of length 3 and twelve counts
    told = in_groups(counted, shapes, "ord long, key long, n long").groupBy("ord", "key").agg(F.sum("n").alias("n")).toArrow()
    order, key, n = (told.column(x).to_numpy() for x in ("ord", "key", "n"))
    of = {k: np.zeros(4, int) for k in range(1, 7)}
    for k in (4, 5, 6):
        of[k][key[order == k] - 1] = n[order == k]
    short = {3: (key[order == 3], n[order == 3])}
    for k in (2, 1):
        short[k] = left_neighbours(short[k + 1][0], k)
    for k in (1, 2, 3):
        of[k] = _times(short[k][1])
    cuts = {k: discounts(tuple(of[k].tolist())) for k in of}
    lower, p = None, None
    for k in (1, 2, 3):
        grams, adjusted = short[k]
        by_gram = np.argsort(grams)
        grams, adjusted = grams[by_gram], adjusted[by_gram]
        below = np.full(len(grams), 1 / SYMBOLS) if k == 1 else p[np.searchsorted(lower, grams & low(k - 1))]
        lower, p = grams, interpolated(grams, adjusted, cuts[k], below)
    shared = spark.sparkContext.broadcast((lower, p))

    def score(part: pa.Table) -> pa.Table:
        grams, known = shared.value
        orders = _orders(part.column("gram").to_numpy(), part.column("c").to_numpy())
        own = known[np.searchsorted(grams, orders[4][0] & low(3))]
        for k in (4, 5, 6):
            if k > 4:
                own = own[np.searchsorted(orders[k - 1][0], orders[k][0] & low(k - 1))]
            own = interpolated(*orders[k], cuts[k], own)
        back = np.searchsorted(orders[6][0], part.column("gram").to_numpy())
        return pa.table([part.column("gram"), part.column("n"), pa.array(np.log10(own)[back])], names=["gram", "n", "lp"])

    return in_groups(counted, score, "gram long, n long, lp double")


def repeated_words(hashes: np.ndarray) -> int:
    """How many words stand in a 3-word window that the text holds twice or more; takes the words' hashes."""
    if len(hashes) < 4:
        return 0
    key = hashes[:-2] * _P + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SIGNS)), 0, 0
    solid = text.translate(None, b" \t\n\r\x0b\x0c")
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return len(words), chars, len(solid) - len(solid.translate(None, SIGNS)), len(lines) - len(set(lines)), repeated_words(hashes)


DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lp_sum_ double, rare_grams_ array<long>, text_hash_ long"


def digest(docs: DataFrame, scored: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the base counts, the log10 probability of the text's frequent grams, the other grams and a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(scored))

    def run(column):
        rows = []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0):
            texts = utf8(part.column(0))
            split = [t.split() for t in texts]
            sums, who, rest = text_scores([b" ".join(w).lower() for w in split], shared.value)
            rare: list[list[int]] = [[] for _ in texts]
            for i, gram in zip(who.tolist(), rest.tolist()):
                rare[i].append(gram)
            for t, words, lp, grams in zip(texts, split, sums.tolist(), rare):
                counts = base_counts(t, words)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
                rows.append((*counts, failed, lp, grams, xxhash.xxh64_intdigest(t) - 2**63))
        return list(zip(*rows)) if rows else [[]] * 9

    return add_columns(docs, [text], run, DIGEST, drop)


def language(column: str):
    """A lower-case code of two or three letters, else `und`: at most 18,253 values."""
    code = F.lower(F.substring_index(F.substring_index(F.col(column), "-", 1), "_", 1))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.lit("und"))


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """lang_code, low, high: the band of log10 perplexity of each language, from its distinct texts that passed the base rules.

    Quartiles are approximate: their rank is off by at most a ten-thousandth of a language's texts (exact below 10,000).
    """
    passed = scored.where("log10_perplexity is not null and not base_failed")
    distinct = passed.groupBy("lang_code", "text_hash_").agg(F.min("log10_perplexity").alias("log10_perplexity"))
    quartiles = F.percentile_approx("log10_perplexity", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    found = distinct.groupBy("lang_code").agg(quartiles.alias("q"))
    q1, q3 = F.element_at("q", 1), F.element_at("q", 2)
    iqr = F.greatest(q3 - q1, F.lit(LEAST_IQR))
    return found.select("lang_code", (q1 - lower * iqr).alias("low"), (q3 + upper * iqr).alias("high"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", lower: float = LOWER, upper: float = UPPER, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the base counts, lang_code, log10_perplexity a word, the band (low, high) and kept; one row for each row of docs.

    kept is false if base_failed, else whether the perplexity is in the band. Null texts count as empty (no words:
    base_failed, no perplexity); a null or odd language is judged with the others of that kind. Repeated rows are judged
    each. An empty table gives none. A column of docs with one of these names is replaced.
    """
    model = materialise(score_grams(materialise(count_grams(distinct_texts(docs, text), F.col("text"), F.lit(True), normal), "grams")), "scored-grams")
    made = ["lang_code", "log10_perplexity", "low", "high", "kept", "row_of_rules_"]
    digested = digest(docs.withColumn("lang_code", language(lang)), model, text, tuple(x for x in (*drop, *made[1:]) if x != text or text in drop))
    rows = materialise(digested.withColumn("row_of_rules_", F.monotonically_increasing_id()), "quality-rules")
    others = rows.select("row_of_rules_", F.explode("rare_grams_").alias("gram")).join(model.select("gram", "lp").hint("merge"), "gram", "left")
    added = others.groupBy("row_of_rules_").agg(F.sum(F.coalesce("lp", F.lit(-math.log10(SYMBOLS)))).alias("added"))
    narrow = rows.select("row_of_rules_", "lang_code", "text_hash_", "base_failed", "n_words", "lp_sum_").join(added.hint("merge"), "row_of_rules_", "left")
    perplexity = F.when(F.col("n_words") > 0, -(F.col("lp_sum_") + F.coalesce("added", F.lit(0.0))) / F.col("n_words"))
    narrow = materialise(narrow.select("row_of_rules_", "lang_code", "text_hash_", "base_failed", perplexity.alias("log10_perplexity")), "perplexities")
    # the bands have at most 18,253 short rows
    banded = narrow.join(F.broadcast(bands(narrow, lower, upper)), "lang_code", "left")
    inside = F.col("log10_perplexity").between(F.col("low"), F.col("high"))
    verdict = banded.select("row_of_rules_", "log10_perplexity", "low", "high", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
    return rows.drop("lp_sum_", "rare_grams_", "text_hash_").join(verdict.hint("merge"), "row_of_rules_").drop("row_of_rules_")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = quality_rules(docs, drop=("text",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang_code", "log10_perplexity", "low", "high")
