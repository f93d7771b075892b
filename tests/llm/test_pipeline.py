"""The pipeline's stages on the smallest tables."""

import random

import corpus_pipeline
from tracelink.llm import simhash
from tracelink.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] < sizes[0] and sizes[4] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicates_leave_one(spark):
    base = " ".join(f"word{i * 7 % 89}" for i in range(400))
    rows = [(1, base, "en", "s", 0), (2, base, "en", "s", 0), (None, base, "en", "s", 0), (3, base.replace("word5 ", "other "), "en", "s", 0), (4, "an unrelated text of a few words", "en", "s", 0), (5, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs = materialise(docs, "few")
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()
    assert len(kept) == 3


def similar_pairs(n_pairs: int = 60):
    """Texts in pairs (2 * i, 2 * i + 1) of 0.70 to 0.90 similarity, and their exact similarity."""
    rng, texts, exact = random.Random(11), [], []
    for i in range(n_pairs):
        words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        other = list(words)
        for at in rng.sample(range(5, 490, 6), 5 + i * 13 // n_pairs):
            other[at] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
        a, b = (set(simhash.shingle_hashes(t.encode(), corpus_pipeline.SHINGLE).tolist()) for t in texts[-2:])
        exact.append(len(a & b) / len(a | b))
    return texts, exact


def test_near_duplicates_are_decided_on_shingles(spark):
    texts, exact = similar_pairs()
    assert sum(x >= 0.8 for x in exact) > 10 and sum(x < 0.8 for x in exact) > 10
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "pairs")
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()}
    got = [not {2 * i, 2 * i + 1} <= kept for i in range(len(exact))]
    assert not any(g for g, x in zip(got, exact) if x < 0.8)
    near = [g for g, x in zip(got, exact) if x >= 0.8]
    assert sum(near) >= 0.95 * len(near)


def test_verified_links_of_a_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 1500)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join([*base[:at], "new", *base[at + 1 :]]) for at in range(20, 380, 20)]
    rows = materialise(spark.createDataFrame(list(enumerate(texts)), "place long, text string"), "tiles")
    got = simhash.similar_groups(rows, "place", "text", 5, 8, 110, 0.8).collect()
    assert len(got) == len(texts) and {r.component_id for r in got} == {0}


def test_near_duplicates_when_files_are_split_anew(spark, monkeypatch):
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(300)) for i in range(80)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8), "split")
    groups, name = simhash.similar_groups, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)

    def and_split(*args):
        found = materialise(groups(*args), "groups")
        spark.conf.set(name, "2000")
        return found

    monkeypatch.setattr(simhash, "similar_groups", and_split)
    try:
        kept = [r.doc_id // 2 for r in corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(kept) == list(range(40))


def odd_documents(spark):
    """Clashing names, nulls in every column, repeated rows, empty and very long texts, a language of copies."""
    rng = random.Random(2)
    common = [f"{a}{b}" for a in ("re", "in", "con", "de", "per") for b in ("form", "tain", "sult", "act", "vert", "pose", "cede")]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [prose(120) for _ in range(60)] + [None, "", " \n ", "x" * 300_000, prose(40_000), "token = abcdefgh12345678 " + prose(100)]
    texts += [texts[0]] * 20 + ["junk " * 200] * 3
    rows = [(i, t, "en", "s", None if t is None else len(t), f"note {i}", i, "kept?", i / 2) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None, None, None), rows[1], rows[1]]
    return materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, place_of_row long, kept string, fp double").repartition(3), "odd")


def test_stages_of_odd_documents(spark):
    docs = odd_documents(spark)
    by_id = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept = out.collect()
        if name == "simhash_near_dedup":
            assert len(kept) == len({r.text if (r.text or "").split() else "" for r in by_id.values()})
        if name == "secret_scan":
            assert len(kept) == docs.count() and any("[assign]" in (r.text or "") for r in kept)
        else:
            assert all(r == by_id[r.doc_id] for r in kept)
        assert stage(spark, docs.limit(0), SF).count() == 0
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count() and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
