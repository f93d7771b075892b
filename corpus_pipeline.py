"""A corpus pipeline: classify, apply quality rules, remove near-duplicates, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm import packing, quality_classifier, quality_rules, secret_scan, simhash
from tracelink.llm.common import materialise

#: Sets of five-word shingles with a Jaccard similarity of LEAST_SIMILAR are near-duplicates. Their 512-bit fingerprints
#: differ in 78 bits on average (standard deviation 8), so candidates with up to 110 are compared.
SHINGLE, FINGERPRINT_WORDS, MOST_BITS, LEAST_SIMILAR = 5, 8, 110, 0.8


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no stage adds, and those names: a user's column called `score` or `kept` stays what it is."""
    names = {name: f"own_{i}_of_docs" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of hidden() under their own names."""
    return docs.select(*[F.col(own).alias(name) for name, own in names.items()])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier takes for good ones. Null and empty texts are scored as texts without words."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, names = hidden(docs)
    return shown(quality_classifier.score(own, model, names["text"]).where("predicted = 1"), names)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie in their language's perplexity band. Null and empty texts fail the rules."""
    own, names = hidden(docs)
    return shown(quality_rules.quality_rules(own, names["text"], names["lang"]).where("kept"), names)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first row. Rows are told apart by their place, so null or equal ids do no
    harm; all texts without a word are copies of each other.

    Places are written once, since another scan may split the files otherwise and number the rows anew.
    """
    own, names = hidden(docs)
    rows = materialise(own.withColumn("place_of_row", F.monotonically_increasing_id()), "placed-rows")
    groups = simhash.similar_groups(rows, "place_of_row", names["text"], SHINGLE, FINGERPRINT_WORDS, MOST_BITS, LEAST_SIMILAR)
    first = materialise(groups.where("place_of_row = component_id").select("place_of_row"), "kept-rows")
    return shown(rows.join(first.hint("merge"), "place_of_row", "left_semi"), names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows. Null texts stay null, and so does their n_chars."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; a null or empty text is one piece, its end."""
    return packing.best_fit_packing(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The stages need trained models and tokenizers, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
