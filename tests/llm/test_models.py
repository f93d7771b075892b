"""The language models against brute force: every probability by the textbook recursion over plain dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelink.llm import byte_grams, ppm, quality_classifier, quality_rules
from tracelink.llm.byte_grams import END, ORDER, START, SYMBOLS

PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps under a warm tree near the old river bank . "


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = PROSE.split() + ["Étude", "naïve", "日本語", "x" * 300, "a\0b"]
    out = [None, "", " ", "\n\n", "one", "  two  spaced\n words ", PROSE * 30, "A" * 5000, "it's we'll\t1234 ... \r\n end"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    out += [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(90)) for _ in range(8)]
    out = [(i, t, ("en", None, "fr", "??")[i % 4], "x", 0.5, "kept") for i, t in enumerate(out)]
    return out + [(None, "null id text", "en", None, None, None), out[10], out[10]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string, score double, kept string").repartition(3).cache()


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def grams(text: bytes):
    s = (START,) * ORDER + tuple(text) + (END,)
    return [s[i - ORDER : i + 1] for i in range(ORDER, len(s))]


def test_gram_slices_cut_long_texts(monkeypatch):
    monkeypatch.setattr(byte_grams, "SLICE", 7)
    texts = [b"", b"a", b"abcdefg", b"abcdefghijklmnopqrstuvw", b"x" * 14, "ñandú".encode()]
    got = defaultdict(list)
    for found, begins, owners in byte_grams.gram_slices(texts):
        for a, b, i in zip(begins, [*begins[1:], len(found)], owners):
            got[int(i)] += [tuple(int(g) >> 9 * k & 511 for k in range(ORDER, -1, -1)) for g in found[a:b]]
    assert [got[i] for i in range(len(texts))] == [grams(t) for t in texts]


def test_hash_array_finds_what_it_holds():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 54, 5000))
    held = byte_grams.HashArray(keys[::2], np.arange(len(keys[::2]), dtype=float))
    value, there = held.find(keys)
    assert there[::2].all() and not there[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()
    assert not byte_grams.HashArray(keys[:0], np.zeros(0)).find(keys)[1].any()


def brute_ppm(train: list[bytes]):
    counts = defaultdict(Counter)
    for t in train:
        for g in grams(t):
            for k in range(ORDER + 1):
                counts[g[ORDER - k : ORDER]][g[-1]] += 1
    fresh, events = Counter(), Counter()
    shape = lambda total, kinds: (min(math.frexp(max(total, 1))[1], 39), min(kinds, 7))
    for context, seen in counts.items():
        total, kinds = sum(seen.values()), len(seen)
        if len(context) == ORDER and total > 1:
            for n in seen.values():
                if n == 1:
                    fresh[shape(total - 1, kinds - 1)] += 1
                    events[shape(total - 1, kinds - 1)] += 1
                else:
                    events[shape(total - 1, kinds)] += n

    def log10(gram):
        out, gone = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = counts.get(gram[ORDER - k : ORDER], {})
            left = {s: n for s, n in seen.items() if s not in gone}
            if not left:
                continue
            total = sum(left.values())
            c = shape(total, len(left))
            leave = (fresh[c] + 1) / (events[c] + 2) if k == ORDER else len(left) / (total + len(left))
            if gram[-1] in left:
                return out + math.log10(left[gram[-1]] / total * (1 - leave))
            out += math.log10(leave)
            gone = set(seen)
        return out - math.log10(SYMBOLS - len(gone))

    return log10


def test_ppm_against_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 5)
    monkeypatch.setattr(byte_grams, "FREQUENT", 50)
    monkeypatch.setattr(byte_grams, "GROUP", 300)
    got = ppm.score_documents(docs)
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    train = Counter()
    for i, t, *_ in rows:
        if learns(i):
            train.update(words(lower(t)))
            train[""] += 1
    n, v = sum(train.values()), len(train)
    log10 = brute_ppm([lower(t).encode() for i, t, *_ in rows if learns(i)])
    assert got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    for i, t, *_ in rows:
        tokens, r = words(lower(t)) + [""], by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(sum(map(log10, grams(lower(t).encode()))), rel=1e-5)


def test_ppm_is_a_distribution():
    log10 = brute_ppm([PROSE.encode(), b"another text"])
    for context in (b" the ", b"e qui", b"zzzzz"):
        p = sum(10 ** log10((*context, s)) for s in range(SYMBOLS))
        assert p <= 1 + 1e-9 and (context == b"zzzzz" or p > 0.5)
    assert ppm.adaptive_bits(b"abababababab") < ppm.adaptive_bits(b"qzjxkvwpyfgh")


def test_ppm_of_nothing(spark, docs):
    assert ppm.score_documents(docs.limit(0)).count() == 0
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    assert held.count() and all(r.score < 0 and r.train_tokens == 0 for r in ppm.score_documents(held).collect())


def brute_kneser_ney(texts: list[bytes]):
    n = [Counter() for _ in range(ORDER + 2)]
    for t in texts:
        n[ORDER + 1].update(grams(t))
    for k in range(ORDER, 0, -1):
        n[k].update(g[1:] for g in n[k + 1])
    cut = [quality_rules.discounts(tuple(sum(x == i for x in m.values()) for i in range(1, 5))) for m in n]
    of = [defaultdict(list) for _ in n]
    for k in range(1, ORDER + 2):
        for g, x in n[k].items():
            of[k][g[:-1]].append(x)

    def p(gram):
        if not gram:
            return 1 / SYMBOLS
        k, same = len(gram), of[len(gram)][gram[:-1]]
        return (n[k][gram] - cut[k][min(n[k][gram], 3)] + sum(cut[k][min(x, 3)] for x in same) * p(gram[1:])) / sum(same)

    return p


def test_kneser_ney_and_bands_against_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(byte_grams, "FREQUENT", 50)
    monkeypatch.setattr(byte_grams, "GROUP", 300)
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    lang = lambda x: x if x in ("en", "fr") else "und"
    normal = lambda t: " ".join(words(lower(t))).encode()
    times, sizes = Counter((lang(r[2]), r[1]) for r in rows), Counter(lang(r[2]) for r in rows)
    hot = {t for (x, t), k in times.items() if k >= max(2, 0.01 * sizes[x])}
    p = brute_kneser_ney([normal(r[1]) for r in rows if r[1] not in hot] + [normal(t) for t in hot])
    want = lambda t: -sum(math.log10(p(g)) for g in grams(normal(t))) / len(words(lower(t)))
    for r in got:
        assert (r.log10_perplexity is None) == (not words(r.text or ""))
        if r.log10_perplexity is not None:
            assert r.log10_perplexity == pytest.approx(want(r.text), rel=1e-4)
    for code in ("en", "fr", "und"):
        mine = [r for r in got if r.lang_code == code]
        passed = sorted({r.text: r.log10_perplexity for r in mine if not r.base_failed and r.log10_perplexity is not None}.values())
        q1, q3 = (passed[max(0, math.ceil(len(passed) * q) - 1)] for q in (0.25, 0.75))
        iqr = max(q3 - q1, quality_rules.LEAST_IQR)
        for r in mine:
            assert r.kept == (not r.base_failed and q1 - quality_rules.LOWER * iqr <= r.log10_perplexity <= q3 + quality_rules.UPPER * iqr)


def test_quality_rules_of_nothing(spark, docs):
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def brute_additive(x, y, n_bins, rounds, pair_rounds, n_pairs, rate, prior):
    """Cyclic boosting with loops over rows and bins: (edges, base, tables by feature, tables by pair, log odds of the rows)."""
    width, n = len(x[0]), len(y)

    def quantile(column, q):
        s = sorted(column)
        at = q * (len(s) - 1)
        low = int(at)
        return s[low] + (at - low) * (s[min(low + 1, len(s) - 1)] - s[low])

    edges = [sorted({quantile([r[f] for r in x], k / n_bins) for k in range(1, n_bins)}) for f in range(width)]
    bin_of = lambda f, v: sum(e <= v for e in edges[f])
    bins = [[bin_of(f, r[f]) for f in range(width)] for r in x]
    base = math.log((sum(y) + 1) / (n + 2) / (1 - (sum(y) + 1) / (n + 2)))
    at = [base] * n
    part = lambda g, h: g * g / (h + prior)

    def sums(key, keys):
        g, h = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
        for i in range(n):
            p = 1 / (1 + math.exp(-at[i]))
            g[key(bins[i])] += y[i] - p
            h[key(bins[i])] += p * (1 - p)
        return g, h

    tables = [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(rounds):
        for f in range(width):
            g, h = sums(lambda b: b[f], range(len(tables[f])))
            total = lambda s, a, b: sum(s[k] for k in range(a, b))
            leaves = [(0, len(tables[f]))]
            for _ in range(3):
                found = [(0.0, 0, k) for k in range(len(leaves))]
                for k, (a, b) in enumerate(leaves):
                    for c in range(a + 1, b):
                        gain = part(total(g, a, c), total(h, a, c)) + part(total(g, c, b), total(h, c, b)) - part(total(g, a, b), total(h, a, b))
                        if found[k][1] == 0 or gain > found[k][0] + 1e-12:
                            found[k] = (gain, c - a, k)
                gain, cut, k = max(found)
                if gain <= 1e-9:
                    break
                a, b = leaves[k]
                leaves[k : k + 1] = [(a, a + cut), (a + cut, b)]
            step = [0.0] * len(tables[f])
            for a, b in leaves:
                for k in range(a, b):
                    step[k] = rate * total(g, a, b) / (total(h, a, b) + prior)
            tables[f] = [t + s for t, s in zip(tables[f], step)]
            at = [v + step[bins[i][f]] for i, v in enumerate(at)]

    def quadrants(a, b):
        rows, columns = len(tables[a]), len(tables[b])
        g, h = sums(lambda c: (c[a], c[b]), [(i, j) for i in range(rows) for j in range(columns)])
        best = None
        for i in range(rows):
            for j in range(columns):
                quarter = [[k for k in g if (k[0] <= i) == up and (k[1] <= j) == left] for up in (True, False) for left in (True, False)]
                gs, hs = [sum(g[k] for k in q) for q in quarter], [sum(h[k] for k in q) for q in quarter]
                gain = sum(map(part, gs, hs))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, {k: v / (w + prior) for q, v, w in zip(quarter, gs, hs) for k in q}
        return best

    gains = sorted(((quadrants(a, b)[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    pairs = {(a, b): {} for _, a, b in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), table in pairs.items():
            step = quadrants(a, b)[1]
            for k, v in step.items():
                table[k] = table.get(k, 0.0) + rate * v
            at = [v + rate * step[bins[i][a], bins[i][b]] for i, v in enumerate(at)]
    return edges, base, tables, pairs, at


def test_additive_model_against_loops(monkeypatch):
    rng = np.random.default_rng(4)
    for name, value in (("BINS", 6), ("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(quality_classifier, name, value)
    x = rng.normal(size=(160, 4))
    x[:, 3] = np.round(x[:, 3])  # equal quantiles
    y = (x[:, 0] * x[:, 1] + 0.7 * x[:, 2] * x[:, 3] + 0.3 * rng.normal(size=160) > 0).astype(float)  # no two pairs gain alike
    model = quality_classifier.Additive(x, y)
    edges, base, tables, pairs, at = brute_additive(x.tolist(), y.tolist(), 6, 4, 3, 2, quality_classifier.RATE, quality_classifier.PRIOR)
    assert model.base == pytest.approx(base) and all(a.tolist() == pytest.approx(b) for a, b in zip(model.edges, edges))
    assert all(a.tolist() == pytest.approx(b) for a, b in zip(model.tables, tables)) and list(model.pairs) == list(pairs)
    for key, table in model.pairs.items():
        assert all(table[k] == pytest.approx(v) for k, v in pairs[key].items())
    assert model.score(x).tolist() == pytest.approx([1 / (1 + math.exp(-v)) for v in at])
