"""Fill-in-the-middle, suffix dedup and tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelink.llm import alignment, fim, suffix_dedup
from tracelink.llm.byte_bpe import byte_level_alphabet

SCHEMA = "doc_id long, text string, n string, form string, spans string, n_links double"
WORDS = "the quick brown fox jumps over a lazy dog while Étude naïve 日本語 ends\n\n \t <0x41> <s> ▁x ok".split(" ")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = line(60)
    texts = [None, "", " ", "\n", "\n\n\n", "a", "no end", "one\n", "x\ny", "has <M> in it", "a\0b\r\n c ", "z" * 40_000, "ab" * 9000 + "\n", "long " * 20_000]
    texts += [line(rng.randrange(1, 90)) + "\n" + shared + "\n" + line(rng.randrange(1, 90)) for _ in range(25)]
    texts += [shared, shared, shared[7:90], shared[:49], shared[3:53], "z" * 60, line(400)[:-1] + "q", line(300)]
    out = [(i, t, "n", "f", "s", 0.5) for i, t in enumerate(texts)]
    random.Random(1).shuffle(out)
    return out + [(None, shared + " null", None, None, None, None), (None, shared + " null", None, None, None, None), out[20], (3, texts[20], "", "", "", 1.0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def brute_fim(i, text, end="\n", rate=100):
    t = text or ""
    units = re.findall(rf"[^{end}]*{end}|[^{end}]+", t)
    n = len(units)
    hexes = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("end, rate", [("\n", 100), (" ", 60)])
def test_fim_against_brute_force(docs, rows, end, rate):
    made = fim.fill_in_middle(docs, rate=rate, unit_end=end).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back", "spans").collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    want = [(i, t, *brute_fim(i, t, end, rate), t or "", s) for i, t, _, _, s, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_chunks_follow_content_and_are_remembered():
    rng = np.random.default_rng(0)
    shared = rng.integers(97, 123, 60_000, dtype=np.uint8)
    other = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), shared])
    cut = lambda x: {x[a:b].tobytes() for ends in fim.chunk_ends(x, np.array([len(x)])) for a, b in zip([0, *ends], ends)}
    one, two = cut(shared), cut(other)
    assert len(one & two) >= len(one) - 3 and len(one) > 10
    for text in (np.full(50_000, 65, np.uint8), shared):
        sizes = np.diff([0, *fim.chunk_ends(text, np.array([len(text)]))[0]])
        assert sizes.max() <= fim.MOST and (sizes[:-1] >= fim.LEAST).all() and sizes.sum() == len(text)
    memory = fim.Summaries(b"\n")
    assert memory.of("é\nb".encode()) == (1, 3, False) and memory.of(b"c\n") == (1, 2, True) and len(memory.known) == 2


def brute_repeats(rows, length=50):
    """By row: removed spans and the rest."""
    seen, out = set(), {}
    of = defaultdict(list)
    for k, r in enumerate(rows):
        of[r[0]].append((k, (r[1] or "").encode()))
    for i in sorted(of, key=lambda i: (i is None, i)):
        for k, x in of[i]:
            gone = np.zeros(len(x) + 1, bool)
            for j in range(len(x) - length + 1):
                if x[j : j + length] in seen:
                    gone[j : j + length] = True
            edges = np.flatnonzero(np.diff(np.append(False, gone))).tolist()
            out[k] = list(zip(edges[::2], edges[1::2])), bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        for _, x in of[i]:
            seen.update(x[j : j + length] for j in range(len(x) - length + 1))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "anchor_bytes": 20_000, "hot_blocks": 4}])
def test_repeats_against_brute_force(docs, rows, sizes):
    got = suffix_dedup.cut_repeats(docs, **sizes).collect()
    want = brute_repeats(rows)
    given = Counter((str(r.doc_id), r.n_bytes, str([(s.start, s.end) for s in r.spans]), bytes(r.kept)) for r in got)
    assert given == Counter((str(rows[k][0]), len((rows[k][1] or "").encode()), str(s), x) for k, (s, x) in want.items())
    assert sum(len(s) for s, _ in want.values()) > 30


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    text = np.random.default_rng(5).integers(97, 99, 4000, dtype=np.uint8)
    at = np.arange(0, 3900, 3)
    size, group = np.where(at % 2, 12, 9), at % 2
    brute = [(g, text[a : a + k].tobytes()) for a, k, g in zip(at, size, group)]

    def same(classes):
        return len(set(zip(classes.tolist(), brute))) == len(set(brute)) == len(set(classes.tolist()))

    assert same(suffix_dedup.Suffixes(text).classes(at, size, group))
    monkeypatch.setattr(suffix_dedup, "_BYTES", np.full(256, 3, np.uint64))  # all substrings of one size have one hash
    assert same(suffix_dedup.Suffixes(text).classes(at, size, group))


def test_every_window_has_one_anchor():
    text = np.concatenate([np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8), np.full(300, 65, np.uint8), np.zeros(20, np.uint8)])
    ends = np.array([40, 2000, 5300, 5320])
    _, place, first, last = suffix_dedup.anchors(text, ends)
    windows = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    begins = [0, *ends[:-1]]
    assert sorted(windows) == [w for a, b in zip(begins, ends) for w in range(a, b - 49)]
    assert ((place >= last) & (place - first <= 25)).all()


def brute_alignment(rows):
    left = Tokenizer.from_file(P.path(alignment.LEFT))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.RIGHT))
    byte = byte_level_alphabet()
    a_bytes = {i: bytes(byte[c] for c in p) for p, i in left.get_vocab().items() if all(c in byte for c in p)}
    b_bytes = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    out, held = [], Counter()
    for _, t, *_ in rows:
        s = (" " + (t or "")).encode()
        a, b = left.encode(" " + (t or ""), add_special_tokens=False).ids, right.encode(t or "")
        if not t or b"".join(a_bytes[i] for i in a) != s or b"".join(b_bytes(right.id_to_piece(i)) for i in b) != s:
            out.append(None)
            continue
        a_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist()
        b_end = np.cumsum([len(b_bytes(right.id_to_piece(i))) for i in b]).tolist()
        links, i, j, groups, x, y = Counter(), 0, 0, [], [], []
        while i < len(a):
            links[a[i], b[j]] += 1
            step_a, step_b = a_end[i] <= b_end[j], b_end[j] <= a_end[i]
            x, y = x + a[i : i + step_a], y + b[j : j + step_b]
            i, j = i + step_a, j + step_b
            if step_a and step_b:
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                x, y = [], []
        out.append((len(a), len(b), len(groups), links, sha(";".join(groups).encode())))
        held.update(links.keys())
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else
        (*r[:3], sum(r[3].values()), sum(n for k, n in r[3].items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in r[3].items()), r[4])
        for r in out
    ]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK, 2000])
def test_alignment_against_brute_force(docs, rows, block_bytes):
    got = alignment.align(docs, P.path(alignment.LEFT), P.path(alignment.RIGHT), block_bytes=block_bytes).collect()
    want = [(str(r[0]), *x) for r, x in zip(rows, brute_alignment(rows))]
    assert Counter((str(r.doc_id), *r[1:]) for r in got) == Counter(want)
    assert any(x[1] == 0 and r[1] for r, x in zip(rows, want))  # a text that its pieces don't give back


def test_encoders_give_the_libraries_ids():
    rng = random.Random(8)
    letters = [" ", " ", "\n", "\t", "\r", "　", "\x1c", "▁", "a", "B", "é", "日", "'s", "'", "1", "22", "<|endoftext|>", "<s>", "<0x0A>", "-", "😀", "the", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    left = Tokenizer.from_file(P.path(alignment.LEFT))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.RIGHT))
    spaced = [" " + t for t in texts]
    unpacked = lambda x: None if x is None else np.frombuffer(x, np.uint32).tolist()
    assert [unpacked(x) for x in alignment.side(P.path(alignment.LEFT)).ids(spaced)] == [e.ids for e in left.encode_batch(spaced, add_special_tokens=False)]
    mine = [unpacked(x) for x in alignment.side(P.path(alignment.RIGHT)).ids(spaced)]
    for text, a, b in zip(texts, mine, right.encode(texts)):
        assert a == b or a is None and ("▁" in text or "<0x" in text)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert fim.fill_in_middle(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == 0
    assert alignment.align(none, P.path(alignment.LEFT), P.path(alignment.RIGHT)).count() == 0
