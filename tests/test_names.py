"""Similarity of names by their published definitions, blocks against all pairs, decisions and the cascade."""

import random

import pytest
from pyspark.sql import functions as F

from tracelink import functions
from tracelink.functions import similarity as S
from tracelink.operators import names as N
from tracelink.plans import QUERIES

FIRST = "Rajesh Priya Amit Neha Vikram Anita Suresh Rajech Pryia Anil Sunil Mohammed Muhammad".split()
LAST = "Kumar Sharma Verma Singh Patel Kumarr Sinh Varma Shaikh Sheikh".split()


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100


def partial(a, b):
    if not a or not b:
        return 100 if a == b else 0
    best = 0
    for s, t in ((a, b), (b, a)):
        if len(s) <= len(t):
            best = max([best] + [ratio(s, t[max(0, e - len(s)) : e]) for e in range(1, len(t) + len(s)) if t[max(0, e - len(s)) : e]])
    return best


def parts(a, b):
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set(a, b):
    if not a.split() or not b.split():
        return 0
    both, x, y = parts(a, b)
    if both and (not x or not y):
        return 100
    gap = 1 if both else 0
    n, m = len(both) + gap + len(x), len(both) + gap + len(y)
    out = 100 - 100 * (len(x) + len(y) - 2 * subsequence(x, y)) / (n + m)
    return max(out, 100 - 100 * (gap + len(x)) / (len(both) + n), 100 - 100 * (gap + len(y)) / (len(both) + m)) if both else out


def weighted(a, b):
    if not a or not b:
        return 0
    far, order = max(len(a), len(b)) / min(len(a), len(b)), lambda t: " ".join(sorted(t.split()))
    if far < 1.5:
        return max(ratio(a, b), 0.95 * max(ratio(order(a), order(b)), token_set(a, b)))
    scale = 0.9 if far <= 8 else 0.6
    both, x, y = parts(a, b)
    tokens = 100 if both else max(partial(order(a), order(b)), partial(x, y))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * tokens)


def test_golden_pairs():
    close = lambda got, want: got == pytest.approx(want, abs=0.01)
    assert close(S.ratio(["this is a test"], ["this is a test!"])[0], 96.55)
    assert close(S.partial_ratio(["this is a test"], ["this is a test!"])[0], 100)
    assert close(100 * S.jaro_winkler_of(["MARTHA", "DIXON", "DWAYNE", "", "a"], ["MARHTA", "DICKSONX", "DUANE", "", ""]), [96.11, 81.33, 84, 100, 0])
    assert token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and close(weighted("this is a test", "this is a new test!!!"), 85.5)


def test_measures_equal_their_definitions(spark):
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(FIRST + LAST + ["x" * 70, "Ω mega", "de", "la"]) for _ in range(rng.randrange(0, 4)))
    pairs = [(name(), name()) for _ in range(400)] + [("Kumar", "Rajesh Kumar"), ("", "a"), ("", ""), (None, "x"), ("a b", "b a"), ("Kumar " * 30, "Kumar"), ("ab", "ab " * 40)]
    got = S.with_name_score(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    for r in got:
        a, b = r.a or "", r.b or ""
        assert r.token_set == pytest.approx(token_set(a, b)) and r.weighted == pytest.approx(weighted(a, b)), (a, b)
        assert r.score == max(r.token_set, r.weighted, r.jaro)


def sound(word):
    code = {c: str(i) for i, group in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in group}
    out, last = word[0].upper(), code.get(word[0].upper(), "0")
    for c in word[1:].upper():
        if c in "HW":
            continue
        k = code.get(c, "0")
        if k != last and k != "0":
            out += k
        last = k
    return (out + "000")[:4]


@pytest.mark.parametrize("cell", [2000, 3])
def test_no_pair_of_a_block_is_missed(spark, cell):
    rng = random.Random(2)
    people = list({f"{rng.choice(FIRST)} {rng.choice(LAST)}" for _ in range(80)})
    told = list({f"{rng.choice(FIRST)} {rng.choice(LAST)}" for _ in range(60)}) + ["Kumar", "  ", None]
    rows = lambda x, c: spark.createDataFrame([(v,) for v in x + x[:5]], f"{c} string")
    got = [tuple(r) for r in N.candidate_pairs(rows(told, "mention"), rows(people, "name"), cell).collect()]
    keys = lambda n: {k for w in n.lower().split() for k in ("w" + w, "s" + sound(w), "p" + w[:3])}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in told if a for b in people if keys(a) & keys(b)}


def decision(mention, people):
    scored = sorted(((-max(token_set(mention, n), weighted(mention, n), 100 * float(S.jaro_winkler_of([mention], [n])[0])), i) for i, n in people), key=lambda x: (round(x[0], 9), x[1]))
    scored = [(-s, i) for s, i in scored if -s >= 85]
    if not scored or scored[0][0] < 92:
        return "unresolved", None, []
    if len(scored) > 1 and scored[0][0] - scored[1][0] < 3:
        return "ambiguous", None, [i for _, i in scored[:3]]
    return "resolved", scored[0][1], [scored[0][1]]


def test_cascade(spark):
    people = [("P1", "Rajesh Kumar"), ("P2", "Anil Kumar"), ("P3", "Neha Verma"), ("P4", "Vikram Singh"), ("P5", "Vikram Singh"), ("P6", None), ("P7", "Muhammad Shaikh")]
    registry = [("phone", "+911", "P1"), ("phone", "+912", "P1"), ("phone", "+912", "P2"), ("vehicle", "DL1", "P3"), ("phone", "+913", "P4")]
    told = [
        ("a", "phone", "+911", True, 1.0, "DEL"), ("b", "phone", "+912", True, 1.0, "DEL"), ("c", "phone", "+919", True, 1.0, "DEL"), ("d", "vehicle", "DL1", False, 0.4, "DEL"),
        ("e", "vehicle", "DL1", True, 1.0, "MUM"), ("f", "person", "Kumar", True, 0.9, "DEL"), ("g", "person", "Neha Verma", True, 0.9, None), ("h", "name", "Nobody Atall", True, 0.9, "DEL"),
        ("i", "location", "Delhi", True, 0.86, "DEL"), ("j", "person", " vikram SINGH ", True, 0.9, "DEL"), ("k", "person", "Vikram Singh", True, 0.9, "X"), ("l", "ifsc", "HDFC0001234", True, 1.0, "X"),
        ("m", "person", None, True, 0.9, "X"), ("n", "person", "", True, 0.9, "X"), ("o", "phone", "+913", True, 1.0, "del"), ("p", "person", "Mohamed Sheikh", True, 0.9, "X"),
    ]
    mentions = spark.createDataFrame(told, "source_ref string, entity_type string, value string, eligible boolean, own_confidence double, jurisdiction string")
    persons = spark.createDataFrame(people, "person_id string, name string")
    confirmed = spark.createDataFrame([("person", "Vikram Singh", "P5")], "entity_type string, value string, entity_id string").where("false")
    rejected = spark.range(1).select(N.review_fingerprint(F.lit("phone"), F.lit("+913"), F.lit("exact_phone"), F.lit("DEL "), F.array(F.lit("P4"))).alias("fingerprint"))
    index = spark.createDataFrame(registry, "entity_type string, value string, entity_id string")
    got = {r.source_ref: r for r in N.resolve(mentions, index, persons, confirmed, rejected).collect()}
    assert len(got) == len(told)
    assert (got["a"].status, got["a"].entity_id, got["a"].confidence, got["a"].method) == ("resolved", "P1", 1.0, "exact_phone")
    assert (got["b"].status, got["b"].entity_id, got["b"].proposed) == ("ambiguous", None, ["P1", "P2"])
    assert (got["c"].status, got["c"].method) == ("unresolved", "none") and (got["d"].status, got["d"].confidence) == ("unresolved", 0.4)
    assert got["e"].entity_id == "P3" and (got["i"].status, got["i"].confidence) == ("unresolved", 0.86)
    assert (got["f"].status, got["f"].proposed) == ("ambiguous", ["P1", "P2"]) and (got["g"].status, got["g"].entity_id) == ("resolved", "P3")
    assert (got["h"].status, got["h"].method, got["h"].confidence) == ("unresolved", "fuzzy_name", 0.0)
    assert (got["k"].status, got["k"].proposed) == ("ambiguous", ["P4", "P5"]) and all(got[x].status == "unresolved" for x in "lmn")
    assert (got["o"].status, got["o"].entity_id, got["o"].note) == ("unresolved", None, "rejected by a reviewer")
    for r in told:
        if r[1] in ("person", "name") and r[2]:
            assert (got[r[0]].status, got[r[0]].entity_id, list(got[r[0]].proposed)) == decision(r[2].strip(), [p for p in people if p[1]]), r
    confirmed = spark.createDataFrame([("person", "VIKRAM singh", "P5")], "entity_type string, value string, entity_id string")
    got = {r.source_ref: r for r in N.resolve(mentions, index, persons, confirmed).collect()}
    assert all((got[x].status, got[x].entity_id, got[x].confidence) == ("resolved", "P5", 100.0) for x in "jk")
    assert N.resolve(mentions.limit(0), index, persons).count() == 0


def test_review_queue_asks_once(spark):
    rows = [(f"r{i}", "phone", v, "exact_phone", j, "ambiguous", 1.0, ["P2", "P1"]) for i, (v, j) in enumerate([("+911", "DEL"), (" +911", "del"), ("+912", "DEL"), ("+913", None)])]
    rows.append(("r9", "phone", "+914", "exact_phone", "DEL", "resolved", 1.0, ["P1"]))
    resolved = spark.createDataFrame(rows, "source_ref string, entity_type string, value string, method string, jurisdiction string, status string, confidence double, proposed array<string>")
    queue = {r.value: r for r in N.review_queue(resolved).collect()}
    assert set(queue) == {"+911", "+912", "+913"} and (queue["+911"].mentions, queue["+911"].first_ref) == (2, "r0")
    decided = spark.createDataFrame([(queue["+912"].fingerprint, "rejected"), (queue["+913"].fingerprint, "pending")], "fingerprint string, status string")
    assert {r.value for r in N.review_queue(resolved, decided).collect()} == {"+911", "+913"}


def test_owners_of_an_identifier_are_not_repeated_by_mention(spark):
    told = [(f"r{i:02}", "phone", "+911", True, 1.0, "DEL" if i % 2 else None) for i in range(12)] + [("s1", "phone", "+912", True, 1.0, "DEL"), ("s2", "phone", None, True, 1.0, "DEL")]
    mentions = spark.createDataFrame(told, "source_ref string, entity_type string, value string, eligible boolean, own_confidence double, jurisdiction string")
    registry = spark.createDataFrame([("phone", "+911", f"P{i}") for i in range(9)] + [("phone", "+912", "P1")], "entity_type string, value string, entity_id string")
    persons = spark.createDataFrame([("P1", "Anil Kumar")], "person_id string, name string")
    narrow = {r.source_ref: r for r in N.resolve(mentions, registry, persons, lists=False).collect()}
    assert all(narrow[f"r{i:02}"].proposed == [] and narrow[f"r{i:02}"].by_list and narrow[f"r{i:02}"].status == "ambiguous" for i in range(12))
    assert narrow["s1"].proposed == ["P1"] and not narrow["s1"].by_list and not narrow["s2"].by_list
    whole = {r.source_ref: r.proposed for r in N.resolve(mentions, registry, persons).collect()}
    assert whole["r03"] == [f"P{i}" for i in range(9)] and whole["s1"] == ["P1"] and whole["s2"] == []
    by = lambda queue: sorted(map(str, queue.select("fingerprint", "value", "jurisdiction", "proposed", "mentions", "first_ref").collect()))
    assert by(N.review_queue(N.resolve(mentions, registry, persons, lists=False), None, N.owner_lists(registry))) == by(N.review_queue(N.resolve(mentions, registry, persons)))


@pytest.mark.parametrize("frequent", [False, True])
def test_rows_without_a_key_are_dealt(spark, frequent, monkeypatch):
    monkeypatch.setattr(functions, "FREQUENT", 5)
    left = spark.createDataFrame([(i, None if i % 2 else "a" if i % 4 else str(i)) for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("4", 2), ("x", 3)], "k string, v int")
    joined = functions.spread_join(left, right, ["k"], frequent)
    assert sorted(map(tuple, joined.select("i", "v").collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").select("i", "v").collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        least = functions.spread_join(left, right, ["k"], frequent).where("k is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(least) > 1


def test_resolution_query_names_each_owner_once(spark):
    rows = QUERIES["d7_resolution"](spark, "/root/testdata/sf0.001").persist()
    asked = {r.proposed_as for r in rows.where("part = 'mention' AND proposed_as IS NOT NULL").collect()}
    lists = rows.where("part = 'proposal'").collect()
    assert asked and asked == {r.proposed_as for r in lists} and len({(r.proposed_as, r.proposed) for r in lists}) == len(lists)
