"""Mentions in text as Spark columns: identifiers and rule entities with the places of every occurrence, and their fusion.

A place is counted in characters from 0; ends are exclusive. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import rules
from tracelink.functions.rules import places

# What entities look like in a statement; group 1 is the entity and ends each expression.
PERSON = r"\b(?:Complainant|Accused|Witness|Suspect|named|states\s+that)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
LOCATION = r"\b(?:in|at|near|from)\s+([A-Z][A-Za-z0-9][A-Za-z0-9\s\-]{1,38}[A-Za-z0-9])"
ORGANISATION = r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Police|Logistics|Bank|Corporation|Ltd\.?|Limited))\b"
EVENT = r"(?i)\b(robbery(?:\s+event)?|cyber crime|organized crime|organised crime|theft|fraud|murder|assault|extortion)\b"
CASE_REFERENCE = r"(?i)\b(FIR(?:\sNO\.?|\s|/|-)\s*[A-Z]{0,3}[\s/\-]*\d{4}[\s/\-]*\d+|FIR\d{5,})\b"
ENTITIES = (("person", PERSON), ("location", LOCATION), ("organisation", ORGANISATION), ("event", EVENT), ("event", CASE_REFERENCE))
# Vehicles and branch codes, in either case.
VEHICLE, IFSC = r"(?i)\b[A-Z]{2}\d{2}[A-Z]{1,3}\d{4}\b", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"
NOT_TEXT = ("source_ref", "jurisdiction", "metadata")


def _spans(kind: str, found: Column, normal) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("entity_type"), normal(x["value"]).alias("value"), x["value"].alias("raw"), x["start"].alias("starts"), (x["start"] + F.length(x["value"])).alias("ends")))


def _phone(raw: Column) -> Column:
    return F.concat(F.lit("+91"), F.right(F.regexp_replace(raw, "[^0-9]", ""), F.lit(10)))


def _tight(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"\s+", ""))


def identifier_spans(text: Column, prose: Column | bool = True, account_field: Column | bool = False) -> Column:
    """Array of the identifiers of a text with their normal values and places. In prose, numbers count only where the words before
    them allow it; elsewhere every phone counts, and bare numbers are accounts in fields named for them. Null for null."""
    prose, account_field = (x if isinstance(x, Column) else F.lit(x) for x in (prose, account_field))
    phones = F.filter(places(text, rules.PHONE), lambda x: ~prose | rules.is_phone(text, x))
    numbers = F.filter(places(text, rules.NUMERIC_ACCOUNT), lambda x: account_field | (prose & rules.is_account(text, x)))
    parts = [_spans("phone", phones, _phone), _spans("vehicle", places(text, VEHICLE), _tight), _spans("bank_account", places(text, rules.ACCOUNT), _tight), _spans("bank_account", numbers, _tight), _spans("ifsc", places(text, IFSC), _tight)]
    return F.concat(*parts)


def entity_spans(text: Column) -> Column:
    """Array of persons after a role, places after a preposition, organisations by their last word, events and case references of a
    statement; each place of a kind once."""
    def of_kind(kind: str, pattern: str) -> Column:
        told = F.transform(places(text, pattern), lambda x: F.struct(F.regexp_extract(x["value"], pattern, 1).alias("v"), (x["start"] + F.length(x["value"])).alias("e")))
        return F.transform(told, lambda x: F.struct(F.lit(kind).alias("entity_type"), x["v"].alias("value"), x["v"].alias("raw"), (x["e"] - F.length(x["v"])).alias("starts"), x["e"].alias("ends")))

    return F.array_distinct(F.concat(*[of_kind(k, p) for k, p in ENTITIES]))


def entity_confidence(kind: Column) -> Column:
    """The rules' confidence in a kind of entity."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.RULE_CONFIDENCE.items() for x in pair]), kind)


def fused(entities: DataFrame, identifiers: DataFrame, doc: str = "source_ref") -> DataFrame:
    """The entities that no identifier of their document overlaps. Both have doc, starts, ends; entities keep their columns.

    One sweep along each document: in the order of their begins, an entity sees how far the identifiers so far reach and where
    the next one begins. No pairs are made; documents of many spans cost no more than their sorting.
    """
    own = [c for c in entities.columns]
    left = entities.select(*own, F.lit(False).alias("is_identifier"))
    right = identifiers.select(*[F.col(c) if c in (doc, "starts", "ends") else F.lit(None).cast(entities.schema[c].dataType).alias(c) for c in own], F.lit(True).alias("is_identifier"))
    line = Window.partitionBy(doc).orderBy("starts")
    only = lambda c: F.when(F.col("is_identifier"), F.col(c))
    reach = F.max(only("ends")).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(only("starts")).over(line.rangeBetween(1, Window.unboundedFollowing))
    seen = left.unionByName(right).withColumns({"reach_of_line": reach, "next_of_line": following})
    free = ~F.coalesce(F.col("reach_of_line") > F.col("starts"), F.lit(False)) & ~F.coalesce(F.col("next_of_line") < F.col("ends"), F.lit(False))
    return seen.where(~F.col("is_identifier") & free).select(*own)


def record_mentions(rows: DataFrame, record: str = "record_id", text: str = "text") -> DataFrame:
    """(record, field, entity_type, value, raw, starts, ends): identifiers of every column of any table but `record` and those that
    are no text to search (source_ref, jurisdiction, metadata). Only the column `text` is prose and kept as it stands; others are
    read as trimmed text."""
    fields = [c for c in rows.columns if c not in (record, *NOT_TEXT)]
    if not fields:
        return rows.sparkSession.createDataFrame([], f"{record} string, field string, entity_type string, value string, raw string, starts int, ends int")
    cell = lambda c: F.col(f"`{c}`").cast("string") if c == text else F.trim(F.col(f"`{c}`").cast("string"))
    long = rows.select(record, *[cell(c).alias(c) for c in fields]).unpivot([record], [F.col(f"`{c}`") for c in fields], "field", "cell_of_record").where("cell_of_record <> ''")
    found = identifier_spans(F.col("cell_of_record"), F.col("field") == text, F.lower("field").contains("account"))
    return long.select(record, "field", F.inline(found))


def mentions(narratives: DataFrame) -> DataFrame:
    """Each different identifier of each narrative(source_ref, jurisdiction, event_date, text)."""
    found = narratives.select("source_ref", "jurisdiction", "event_date", F.inline(identifier_spans(F.col("text"))))
    return found.select("source_ref", "jurisdiction", "event_date", "entity_type", "value").distinct()
