"""Language-model scoring by prediction by partial matching over bytes.

A text is read as its bytes (A-Z lower-cased) and an end. The context of a byte is the ORDER bytes before it, whatever
they are, white space among them; from there it backs off to four, three, two, one and no bytes and at last to all
257 symbols alike. Each context that does not hold the symbol costs its escape, and its symbols are excluded from the
shorter ones. The escape from a longest context is estimated from the corpus by leaving out each occurrence in turn
(class Escapes); that from a shorter one costs U / (T + U), with T occurrences and U different symbols left in it.

The trie of contexts and how texts are scored by it is told in byte_grams.py: it is never in one place and grows with
the corpus. `adaptive_bits` is the adaptive form: one text is coded by what came before in it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.byte_grams import BITS, END, SYMBOLS, count_grams, frequent, group, in_groups, low, most_frequent, text_scores
from tracelink.llm.common import add_columns, materialise, utf8

#: Tokens whose counts go to every task.
FREQUENT = 200_000


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; its end is left to the caller."""
    return text.lower().split()


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """word (binary; empty: the end), c: occurrences in the training texts, n: in all."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            other: Counter = Counter()
            for t, out in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                counts = other if out else seen
                counts.update(tokens(t))
                counts[b""] += 1
            words = [*(seen | other)]
            c = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
            n = c + np.fromiter(map(other.__getitem__, words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])

    made = docs.select(F.col(text).alias("t"), held_out(doc_id).alias("o")).mapInArrow(run, "word binary, c long, n long")
    return made.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Escapes:
    """How often a longest context is left, by its occurrences (as a power of two) and different symbols (up to 7), estimated
    by leaving out each occurrence in turn: a symbol that a context has once is then new there."""

    SHAPE = (40, 8)
    SIZE = 320

    def __init__(self, fresh: np.ndarray, events: np.ndarray):
        self.rate = (fresh + 1) / (events + 2)

    @staticmethod
    def classes(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        power = np.minimum(np.frexp(np.maximum(total, 1).astype(float))[1], Escapes.SHAPE[0] - 1)
        return power * Escapes.SHAPE[1] + np.minimum(kinds, Escapes.SHAPE[1] - 1).astype(int)

    def of(self, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return self.rate[self.classes(total, kinds)]


class Contexts:
    """Counts of the contexts of one length: by gram, and by context its occurrences, its different symbols and how often the
    next shorter context has these symbols."""

    def __init__(self, grams: np.ndarray, c: np.ndarray, shorter: np.ndarray):
        self.grams, self.c = grams, c
        self.contexts, back = group(grams >> BITS)
        n = len(self.contexts)
        seen = c > 0
        self.total = np.bincount(back, c, n)
        self.kinds = np.bincount(back, seen, n)
        self.over = np.bincount(back, np.where(seen, shorter, 0), n)

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        """The grams' count, and their context's occurrences, different symbols and excess for the next shorter one."""
        return (_look(self.grams, self.c, grams), *(_look(self.contexts, x, grams >> BITS) for x in (self.total, self.kinds, self.over)))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def context_orders(grams: np.ndarray, c: np.ndarray, n_symbols: int, shorter: list[Contexts]) -> list[Contexts]:
    """The contexts of grams of n_symbols and of all shorter ones down to those that `shorter` (by context length) has."""
    sums = []
    for k in range(n_symbols, len(shorter), -1):
        own, back = group(grams & low(k))
        sums.append((own, np.bincount(back, c, len(own))))
    out = list(shorter)
    for own, times in reversed(sums):
        k = len(out)
        out.append(Contexts(own, times, _look(out[-1].grams, out[-1].c, own & low(k)) if out else np.zeros(len(own))))
    return out


def gram_scores(grams: np.ndarray, orders: list[Contexts], escapes: Escapes) -> np.ndarray:
    """log10 probability of the last symbol of each gram after the others; orders are the contexts by length."""
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    over, kinds = np.zeros(len(grams)), np.zeros(len(grams))
    for length in range(len(orders) - 1, -1, -1):
        count, total, different, above = orders[length].of(grams[open_] & low(length + 1))
        left, fresh = total - over[open_], different - kinds[open_]
        hit = (count > 0) & (left > 0)
        if length == len(orders) - 1:
            leave = escapes.of(total, different)
        else:
            leave = fresh / np.maximum(left + fresh, 1)
        out[open_[hit]] += np.log10(count[hit] / left[hit] * (1 - leave[hit]))
        escaped = ~hit & (left > 0)
        out[open_[escaped]] += np.log10(leave[escaped])
        over[open_], kinds[open_] = above, different
        open_ = open_[~hit]
    out[open_] -= np.log10(SYMBOLS - kinds[open_])
    return out


def score_grams(counted: DataFrame) -> DataFrame:
    """gram, n, lp: the log10 probability of every gram of a written count table gram, c, n."""
    spark = counted.sparkSession
    # at most 258**2 * 257 rows
    table = counted.groupBy(F.col("gram").bitwiseAND(low(3)).alias("gram")).agg(F.sum("c").alias("c")).where("c > 0").toArrow()
    short = context_orders(table.column("gram").to_numpy(), table.column("c").to_numpy().astype(float), 3, [])
    shared = spark.sparkContext.broadcast(short)

    def tally(part: pa.Table) -> pa.Table:
        """Events of the longest contexts when each occurrence is left out: those new, and all."""
        grams, c = part.column("gram").to_numpy(), part.column("c").to_numpy()
        grams, c = grams[c > 0], c[c > 0]
        contexts, back = group(grams >> BITS)
        total, kinds, once = (np.bincount(back, x, len(contexts)) for x in (c, np.ones(len(c)), c == 1))
        some = total > 1
        total, kinds, once = total[some], kinds[some], once[some]
        fresh = np.bincount(Escapes.classes(total - 1, kinds - 1), once, Escapes.SIZE)
        events = fresh + np.bincount(Escapes.classes(total - 1, kinds), total - once, Escapes.SIZE)
        at = np.flatnonzero(events)
        return pa.table([pa.array(at), pa.array(fresh[at].astype(float)), pa.array(events[at].astype(float))], names=["class", "fresh", "events"])

    told = in_groups(counted, tally, "class long, fresh double, events double").groupBy("class").agg(F.sum("fresh").alias("fresh"), F.sum("events").alias("events")).toArrow()
    fresh, events = np.zeros(Escapes.SIZE), np.zeros(Escapes.SIZE)
    fresh[told.column("class").to_numpy()] = told.column("fresh").to_numpy()
    events[told.column("class").to_numpy()] = told.column("events").to_numpy()
    escapes = Escapes(fresh, events)

    def score(part: pa.Table) -> pa.Table:
        grams, c = part.column("gram").to_numpy(), part.column("c").to_numpy().astype(float)
        lp = gram_scores(grams, context_orders(grams, c, 6, shared.value), escapes)
        return pa.table([part.column("gram"), part.column("n"), pa.array(lp)], names=["gram", "n", "lp"])

    return in_groups(counted, score, "gram long, n long, lp double")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of docs.

    Learns from the texts that are not held out. Null texts count as empty: their only token is the end. Rows with a null
    id are training texts. Equal rows each come back. Where no text trains, probabilities come from the 257 symbols alone.
    """
    spark = docs.sparkSession
    counted = materialise(count_tokens(docs, doc_id, text), "tokens")
    train, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    norm = math.log10(train + 0.5 * (kinds + 1))
    grams = materialise(count_grams(docs, F.col(text), ~held_out(doc_id), bytes.lower), "grams")
    scored = materialise(score_grams(grams), "scored-grams")
    top = most_frequent(counted, "n", FREQUENT).toArrow()
    often = dict(zip(top.column("word").to_pylist(), [(float(c > 0), math.log10(c + 0.5)) for c in top.column("c").to_pylist()]))
    shared = spark.sparkContext.broadcast((often, frequent(scored)))

    def run(batches):
        """A row for each text with what the frequent tokens and grams give, and one for each other term: a token, or a blank
        and a gram (tokens hold no blank)."""
        often, known = shared.value
        names = ["doc_id", "tag", "term", "tf", "n_tokens", "n_known", "lp", "lc", "rows"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [t.lower() for t in utf8(part.column(1))]
                sums, who, rest = text_scores(texts, known)
                which, term, tf = [], [], []
                odd: Counter = Counter(zip(who.tolist(), rest.tolist()))
                for (k, gram), n in odd.items():
                    which.append(k)
                    term.append(b" %d" % gram)
                    tf.append(n)
                n_rare = len(term)
                head = []
                for k, t in enumerate(texts):
                    counts = Counter(t.split())
                    counts[b""] += 1
                    known_here = lc = 0.0
                    for w, n in counts.items():
                        x = often.get(w)
                        if x is None:
                            which.append(k)
                            term.append(w)
                            tf.append(n)
                        else:
                            known_here += n * x[0]
                            lc += n * x[1]
                    head.append((counts.total(), int(known_here), lc))
                n_rare = len(term)
                tags = np.array([xxhash.xxh64_intdigest(t, 11) - (1 << 63) for t in texts], np.int64)
                n_texts = len(texts)
                which += range(n_texts)
                term += [b" t%d" % (x & 0xFFFFFFFF) for x in tags.tolist()]
                pad = [np.zeros(n_rare, np.int64)]
                tokens_, known_, lc_ = (np.array(x) for x in zip(*head))
                columns = [np.array(tf + [0] * n_texts, np.int64), *(np.concatenate([*pad, x]) for x in (tokens_, known_, sums, lc_)), np.concatenate([*pad, np.ones(n_texts, np.int64)])]
                at = np.array(which)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(tags[at]), pa.array(term, pa.binary()), *map(pa.array, columns)], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    made = docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, tag long, term binary, tf long, n_tokens long, n_known long, lp double, lc double, rows long")
    of_tokens = counted.select(F.col("word").alias("own"), F.when(F.col("c") > 0, 1).otherwise(0).alias("own_known"), F.lit(0.0).alias("own_lp"), F.log10(F.col("c") + 0.5).alias("own_lc"))
    of_grams = scored.select(F.concat(F.lit(" "), F.col("gram").cast("string")).cast("binary"), F.lit(0), "lp", F.lit(0.0))
    met = made.join(of_tokens.union(of_grams).hint("merge"), F.col("term") == F.col("own"), "left")
    of_rare = lambda x: F.col("tf") * F.coalesce(x, F.lit(0))
    sums = met.groupBy("doc_id", "tag").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + of_rare("own_known")).alias("n_known"),
        F.sum(F.col("lp") + of_rare("own_lp")).alias("lp"),
        F.sum(F.col("lc") + of_rare("own_lc")).alias("lc"),
        F.sum("rows").alias("rows"),
    )
    one = lambda x: (F.col(x) / F.col("rows")).cast("long").alias(x)
    each = sums.select("doc_id", "rows", one("n_tokens"), one("n_known"), F.col("lp") / F.col("rows"), F.col("lc") / F.col("rows")).toDF("doc_id", "rows", "n_tokens", "n_known", "score", "lc")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), (F.col("lc") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")


def adaptive_bits(text: bytes, order: int = 3) -> float:
    """Bits to code a text by contexts of up to `order` bytes that adapt as it is read, with exclusion."""
    nodes: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for i in range(len(text) + 1):
        symbol = text[i] if i < len(text) else END
        out: set[int] = set()
        chain = [text[max(0, i - k) : i] for k in range(min(order, i), -1, -1)]
        for context in chain:
            seen = {s: n for s, n in nodes.get(context, {}).items() if s not in out}
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                bits -= math.log2(seen[symbol] / total)
                break
            if seen:
                bits -= math.log2(len(seen) / total)
                out |= seen.keys()
        else:
            bits += math.log2(SYMBOLS - len(out))
        for context in chain:
            node = nodes.setdefault(context, {})
            node[symbol] = node.get(symbol, 0) + 1
    return bits


def adaptive_code_length(docs: DataFrame, text: str = "text", order: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with adaptive_bits of each whole text; null texts count as empty (the end alone)."""
    return add_columns(docs, [text], lambda c: [[adaptive_bits(t, order) for t in utf8(c)]], "adaptive_bits double", drop)


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
