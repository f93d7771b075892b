"""Empty tables, and columns of docs that are called like an added one, for the operators whose own tests have neither."""

import public_tokenizers
import pytest

from tracelink.llm import byte_bpe, quality_classifier, secret_scan, simhash, url_filter

BPE = public_tokenizers.path(byte_bpe.VOCABULARY)
CLASHING = "doc_id long, text string, score string, predicted string, ids string, n_tokens string, ids_sha256 string, spans string, fingerprint string, component_id string, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *"abcdefgh", "kept") for i, t in enumerate(["a token = 'abcdef123456789'", None, "", "word " * 60])]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def model(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    return quality_classifier.fit(docs, labels)


def test_empty_tables_stay_empty(docs, model):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert byte_bpe.encode(none, BPE).count() == byte_bpe.round_trip(none, BPE).count() == 0
    assert secret_scan.redact(none).count() == 0
    assert quality_classifier.score(none, model).count() == 0
    pages = none.selectExpr("doc_id as page_id", "text as url", "extra as host")
    assert url_filter.url_filter(pages).count() == 0


def test_columns_with_an_added_name_are_replaced_and_others_kept(spark, docs, model):
    scored = quality_classifier.score(docs, model)
    assert dict(scored.dtypes)["score"] == "double" and dict(scored.dtypes)["predicted"] == "int" and {r.extra for r in scored.collect()} == {"kept"}
    encoded = byte_bpe.encode(docs, BPE)
    assert dict(encoded.dtypes)["ids"] == "array<int>" and {r.extra for r in encoded.collect()} == {"kept"}
    tripped = byte_bpe.round_trip(docs, BPE)
    assert dict(tripped.dtypes)["n_tokens"] == "bigint" and tripped.count() == 4
    redacted = secret_scan.redact(docs).collect()
    assert len(redacted) == 4 and {r.extra for r in redacted} == {"kept"} and {r.spans for r in redacted} == {"f"}
    pages = spark.createDataFrame([(1, "http://a.org/es/", "h", "p", "r", "v", "kept"), (1, None, "h", "p", "r", "v", "kept")], "page_id long, url string, host string, path string, rule string, verdict string, extra string")
    judged = url_filter.url_filter(pages).collect()
    assert sorted((r.host, r.path, r.verdict) for r in judged) == [("", "", "allow"), ("a.org", "/es/", "allow")]
