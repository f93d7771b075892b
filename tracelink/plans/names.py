"""Queries of the fuzzy names and of the whole cascade over the domain views. Their measures are beyond SQL; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import stored
from tracelink.operators import bound, oracle
from tracelink.operators.names import name_decisions, name_scores, owner_lists, resolve, review_fingerprint, review_queue

MENTIONED = "SELECT c.fir_id AS source_ref, c.location AS jurisdiction, CASE c.ord % 4 WHEN 0 THEN p.name WHEN 1 THEN replace(p.name, 'ee', 'i') WHEN 2 THEN substr(p.name, 1, length(p.name) - 1) ELSE 'Shri ' || p.name END AS value, c.ord FROM {cases} c JOIN {persons} p ON c.person_id = p.person_id"


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "SELECT person_id, name FROM {persons}")


def d4_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each different name that the cases mention, with all three measures."""
    mentions = bound(spark, sf_dir, f"SELECT DISTINCT value AS mention FROM ({MENTIONED}) m")
    scores = name_scores(mentions, _persons(spark, sf_dir).select("name"))
    return scores.select("mention", "name", *[F.round(c, 4).alias(c) for c in ("token_set", "weighted", "jaro", "score")]).where("score >= 85")


def d5_fuzzy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, persons = bound(spark, sf_dir, f"SELECT DISTINCT value AS mention FROM ({MENTIONED}) m"), _persons(spark, sf_dir)
    decided = name_decisions(mentions, name_scores(mentions, persons.select("name")), persons)
    return decided.withColumn("confidence", F.round("confidence", 4)).withColumn("proposed", F.array_join("proposed", ","))


def d7_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions, identifiers and names, through the cascade; some are confirmed or rejected by a reviewer.

    Owners of ambiguous identifiers are not repeated with every mention: rows of part `mention` name them by proposed_as (type and
    value), and rows of part `proposal` give each of these owners once. Other proposed ids, three at most, stand in the mention.
    """
    made: dict[str, DataFrame] = {}
    names = bound(spark, sf_dir, f"SELECT source_ref, jurisdiction, 'person' AS entity_type, value, ord % 9 <> 0 AS eligible, 0.88D AS own_confidence FROM ({MENTIONED}) m", made)
    identifiers = bound(spark, sf_dir, "SELECT source_ref, jurisdiction, entity_type, value, true AS eligible, 1.0D AS own_confidence FROM {mentions}", made)
    confirmed = bound(spark, sf_dir, "SELECT 'vehicle' AS entity_type, vehicle_no AS value, max(person_id) AS entity_id FROM {persons} WHERE ord % 5 = 0 GROUP BY vehicle_no UNION ALL SELECT 'person', 'shri ' || lower(name), min(person_id) FROM {persons} WHERE ord % 7 = 0 GROUP BY name", made)
    barred = bound(spark, sf_dir, "SELECT entity_type, value, jurisdiction FROM {mentions} WHERE entity_type = 'phone' AND right(value, 1) = '3'", made)
    registry = bound(spark, sf_dir, "SELECT entity_type, value, entity_id FROM {registry}", made)
    owners = stored(owner_lists(registry), "owner-lists")
    rejected = barred.distinct().join(owners.hint("merge"), ["entity_type", "value"]).select(review_fingerprint(F.col("entity_type"), F.col("value"), F.lit("exact_phone"), F.col("jurisdiction"), F.col("owners")).alias("fingerprint"))
    out = resolve(names.unionByName(identifiers), registry, _persons(spark, sf_dir), confirmed, rejected, lists=False)
    name = F.concat_ws(":", "entity_type", "value")
    told = stored(out.select(F.lit("mention").alias("part"), "source_ref", "jurisdiction", "entity_type", "value", "status", "method", F.round("confidence", 4).alias("confidence"), "entity_id", F.array_join("proposed", ",").alias("proposed"), F.when(F.col("by_list"), name).alias("proposed_as"), "note"), "resolution")
    asked = told.where("proposed_as is not null").select("entity_type", "value", "proposed_as").distinct()
    lists = owners.join(asked.hint("merge"), ["entity_type", "value"]).select(F.lit("proposal").alias("part"), "entity_type", "value", F.explode("owners").alias("proposed"), "proposed_as")
    return told.unionByName(lists, allowMissingColumns=True)


def d9_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of the narratives' identifiers; phones that end in 3 have been decided before."""
    made: dict[str, DataFrame] = {}
    mentions = bound(spark, sf_dir, "SELECT source_ref, jurisdiction, entity_type, value, true AS eligible, 1.0D AS own_confidence FROM {mentions}", made)
    registry = bound(spark, sf_dir, "SELECT entity_type, value, entity_id FROM {registry}", made)
    resolved = resolve(mentions, registry, bound(spark, sf_dir, "SELECT person_id, name FROM {persons}", made), lists=False)
    owners = stored(owner_lists(registry), "owner-lists")
    before = bound(spark, sf_dir, "SELECT DISTINCT entity_type, value, jurisdiction FROM {mentions} WHERE entity_type = 'phone' AND right(value, 1) = '3'", made)
    decided = before.join(owners.hint("merge"), ["entity_type", "value"]).select(review_fingerprint(F.col("entity_type"), F.col("value"), F.lit("exact_phone"), F.col("jurisdiction"), F.col("owners")).alias("fingerprint"), F.lit("confirmed").alias("status"))
    return review_queue(resolved, decided, owners).withColumn("proposed", F.array_join("proposed", ","))


QUERIES = {f.__name__: f for f in (d4_fuzzy_names, d5_fuzzy_decisions, d7_resolution, d9_reviews)}

ORACLE_SQL = {
    "d9_reviews": oracle("""
        SELECT sha256(concat_ws('|', entity_type, lower(value), 'exact_' || entity_type, upper(jurisdiction), ids)) AS fingerprint, entity_type, value, 'exact_' || entity_type AS method, jurisdiction, ids AS proposed, CAST(1 AS DOUBLE) AS score, count(*) AS mentions, min(source_ref) AS first_ref
        FROM (SELECT m.*, o.ids FROM {mentions} m JOIN (SELECT entity_type, value, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM {registry} GROUP BY 1, 2 HAVING count(*) > 1) o ON m.entity_type = o.entity_type AND m.value = o.value) r
        WHERE NOT (entity_type = 'phone' AND right(value, 1) = '3') GROUP BY entity_type, value, jurisdiction, ids""")
}
