"""Identifiers that recur across cases and jurisdictions: evidence rows from narratives, and findings from evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.functions import rules, spread_join, stored
from tracelink.operators.extraction import identifier_spans
from tracelink.operators.names import IDENTIFIERS

LEAST_CASES, LEAST_JURISDICTIONS = 3, 2
KEY = ("entity_type", "value")
# What every finding says about itself.
LIMITS = ("Identifier recurrence is not proof of common ownership or identity.", "Finding scope is limited to the supplied unstructured FIR records.")
UNDATED = "One or more observations has no recoverable event date."


def evidence(records: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each different identifier of each narrative: source_ref, jurisdiction, content_hash, entity_type, value, raw (as first
    written), status, matched_entity_id, confidence, valid_from, valid_to.

    records(source_ref, jurisdiction, text, metadata map<string,string>); those with a blank reference or jurisdiction are left out,
    and copies of one narrative (equal reference, jurisdiction and text) count once. registry(entity_type, value, entity_id).
    Confidence is the lesser of extraction (1) and resolution (0 if nobody or nothing is known to own the identifier). Dates come from the metadata,
    else from the text; text in no known form stays as it is.
    """
    told = records.where("trim(source_ref) <> '' AND trim(jurisdiction) <> '' AND trim(text) <> ''")
    dates = rules.temporal_bounds(F.coalesce("metadata", F.expr("map()").cast("map<string,string>")), {}, F.col("text"))
    rows = told.select(F.trim("source_ref").alias("source_ref"), F.trim("jurisdiction").alias("jurisdiction"), F.sha2("text", 256).alias("content_hash"), dates.alias("dates"), F.inline(identifier_spans(F.col("text"))))
    once = rows.groupBy("source_ref", "jurisdiction", "content_hash", *KEY).agg(F.min_by("raw", "starts").alias("raw"), F.min("dates").alias("dates"))
    once = stored(once, "finding-mentions")
    owners = registry.where(F.col("entity_type").isin(*IDENTIFIERS)).groupBy(*KEY).agg(F.count_distinct("entity_id").alias("owners"), F.min("entity_id").alias("one"))
    known = spread_join(once, owners, list(KEY), frequent=True)
    status = F.when(F.col("owners") == 1, "resolved").when(F.col("owners") > 1, "ambiguous").otherwise("unresolved")
    return known.select(
        "source_ref", "jurisdiction", "content_hash", *KEY, "raw", status.alias("status"), F.when(F.col("owners") == 1, F.col("one")).alias("matched_entity_id"),
        F.when(F.col("owners") >= 1, 1.0).otherwise(0.0).alias("confidence"), F.col("dates.valid_from").alias("valid_from"), F.col("dates.valid_to").alias("valid_to"),
    )


def recurring(rows: DataFrame, cases: int = LEAST_CASES, jurisdictions: int = LEAST_JURISDICTIONS) -> DataFrame:
    """(entity_type, value, cases, jurisdictions) of identifiers in at least so many different cases and jurisdictions.

    Counts are of different (value, case) and (value, jurisdiction) pairs, which are made unique in each task before they meet; an
    identifier of a third of all rows is no single task's.
    """
    if cases < 1 or jurisdictions < 1:
        raise ValueError("thresholds must be at least 1")
    by_case = rows.select(*KEY, "source_ref").distinct().groupBy(*KEY).agg(F.count("*").alias("cases"))
    by_place = rows.select(*KEY, "jurisdiction").distinct().groupBy(*KEY).agg(F.count("*").alias("jurisdictions"))
    return by_case.where(F.col("cases") >= cases).join(by_place.where(F.col("jurisdictions") >= jurisdictions).hint("merge"), list(KEY))


def findings(rows: DataFrame, cases: int = LEAST_CASES, jurisdictions: int = LEAST_JURISDICTIONS) -> DataFrame:
    """One row for each finding over evidence(): finding_id, claim, counts, confidence (the least of its evidence), limits (array),
    matched_entity_ids (in order), valid_from and valid_to (least and greatest date as text). The evidence itself stays in its own
    rows, joined by type and value, since one identifier may have any number of them."""
    found = recurring(rows, cases, jurisdictions)
    whole = rows.groupBy(*KEY).agg(
        F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("matched_entity_id")).alias("matched_entity_ids"), F.count_if(F.col("valid_from").isNull()).alias("undated"),
        F.min(F.least("valid_from", "valid_to")).alias("valid_from"), F.max(F.greatest("valid_from", "valid_to")).alias("valid_to"), F.count("*").alias("observations"),
    )
    limits = F.concat(F.array(*map(F.lit, LIMITS)), F.when(F.col("undated") > 0, F.array(F.lit(UNDATED))).otherwise(F.array().cast("array<string>")))
    claim = F.format_string("The %s identifier %s recurs across %d distinct cases in %d jurisdictions.", "entity_type", "value", "cases", "jurisdictions")
    return found.join(whole.hint("merge"), list(KEY)).select(F.concat_ws(":", F.lit("AN-2"), *KEY).alias("finding_id"), *KEY, claim.alias("claim"), "cases", "jurisdictions", "observations", F.round("confidence", 4).alias("confidence"), limits.alias("limits"), "matched_entity_ids", "valid_from", "valid_to")
