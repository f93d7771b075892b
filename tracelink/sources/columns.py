"""Tables of any shape: overlays below base rows, internal and empty columns dropped, cells cleaned, samples of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import rules


def with_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base rows, then overlay rows; a column that one of them lacks is null there. Columns of both must have one type."""
    return base.unionByName(overlay, allowMissingColumns=True)


def records(rows: DataFrame, drop_internal: bool = True) -> DataFrame:
    """rows without internal columns (names that begin with _), NaN as null."""
    kept = [f for f in rows.schema.fields if not (drop_internal and f.name.startswith("_"))]
    cell = lambda f: F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
    return rows.select(*map(cell, kept))


def clean_upload(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text cells trimmed and null for words for nothing, headers trimmed; columns without a header or named unnamed..., and those
    without a value in any row, are left out (not those in keep).

    One aggregation over all columns tells which hold something; its one row comes to the driver. Of headers that are equal once
    trimmed the first counts.
    """
    names: dict[str, str] = {}
    for c in rows.columns:
        own = c.strip()
        if c in keep or own and not own.lower().startswith("unnamed") and own not in names.values():
            names[c] = c if c in keep else own
    texts = {f.name for f in rows.schema.fields if f.dataType.typeName() == "string"}
    cell = lambda c: rules.clean(F.col(f"`{c}`")) if c in texts else F.col(f"`{c}`")
    clean = rows.select(*[(F.col(f"`{c}`") if c in keep else cell(c)).alias(n) for c, n in names.items()])
    tested = [n for c, n in names.items() if c not in keep]
    held = clean.agg(*[F.count(f"`{n}`").alias(f"n{i}") for i, n in enumerate(tested)]).head() if tested else []
    empty = {n for n, k in zip(tested, held) if not k}
    return clean.select(*[F.col(f"`{n}`") for n in names.values() if n not in empty])


def column_samples(rows: DataFrame, order: str, most: int = 3) -> DataFrame:
    """(field, n, value): the first values of every column but `order` that are not null, as text, in that order.

    Every column's candidates are cut down in each task before they meet: a shuffle moves at most `most` rows a column and task.
    """
    columns = [c for c in rows.columns if c != order]
    if not columns:
        return rows.sparkSession.createDataFrame([], "field string, n int, value string")
    texts = rows.select(F.col(order).alias("at"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = texts.unpivot(["at"], [F.col(f"`{c}`") for c in columns], "field", "value").where("value is not null")
    place = F.row_number().over(Window.partitionBy("field").orderBy("at"))
    return long.withColumn("n", place).where(F.col("n") <= most).select("field", "n", "value")


# Spellings of a narrative record's keys, in the order in which they count.
ALIASES = {
    "source_ref": ("source_ref", "fir_id", "case_ref", "fir", "id"),
    "text": ("text", "raw_text", "narrative", "narrative_text", "fir_text"),
    "jurisdiction": ("jurisdiction", "juris", "state"),
    "source": ("source",),
}
DATES = ("event_date", "date", "occurred_at", "valid_from")


def narrative_records(docs: DataFrame, column: str = "doc") -> DataFrame:
    """source, source_ref, text, jurisdiction (UNSPECIFIED if none), metadata and reason of JSON records of whatever keys, one a row.

    Keys count without case and blanks around them; of two spellings of a field the first of ALIASES that holds something wins.
    metadata is a map of text: what the record's own metadata object holds, its dates, and all keys that are no field. A reason
    tells why a row is no narrative: no JSON object, no reference, no text, or metadata that is no object. Nested values stay JSON
    text. Other columns of docs are kept; of equal keys the last counts.
    """
    entries = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    lower = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("low"), e["key"].alias("key"), e["value"].alias("value")))
    own = [c for c in docs.columns if c != column]
    held = docs.select(*own, lower.alias("entries_of_doc"))
    # each step is a column that the next ones name: an expression would be worked out anew wherever it stands, in lambdas for each entry
    pairs, record, inner, named = map(F.col, ("entries_of_doc", "record_of_doc", "inner_of_doc", "named_of_doc"))
    held = held.select(*own, F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["low"] == e["low"])).alias("entries_of_doc"))
    held = held.withColumn("record_of_doc", F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["low"], e["value"]))))
    filled = lambda k: F.when(F.trim(F.try_element_at(record, F.lit(k))) != "", F.trim(F.try_element_at(record, F.lit(k))))
    field = {f: F.coalesce(*map(filled, names)) for f, names in ALIASES.items()}
    text = F.coalesce(*[F.when(F.trim(F.try_element_at(record, F.lit(k))) != "", F.try_element_at(record, F.lit(k))) for k in ALIASES["text"]])
    given = F.try_element_at(record, F.lit("metadata"))
    meant = F.coalesce(F.from_json(given, "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    held = held.withColumn("inner_of_doc", F.map_filter(meant, lambda k, v: v.isNotNull()))
    known = [n for names in ALIASES.values() for n in names] + list(DATES) + ["metadata"]
    dates = F.filter(pairs, lambda e: e["low"].isin(*DATES) & (F.trim(e["value"]) != "") & (F.coalesce(F.try_element_at(inner, e["low"]), F.lit("")) == ""))
    rest = F.filter(pairs, lambda e: ~e["low"].isin(*known) & (e["value"] != "") & ~F.map_contains_key(inner, e["low"]))
    own_pairs = F.filter(F.map_entries(inner), lambda e: ~(e["key"].isin(*DATES) & (e["value"] == "")))
    held = held.withColumn("named_of_doc", F.concat(own_pairs, F.transform(dates, lambda e: F.struct(e["low"].alias("key"), F.trim(e["value"]).alias("value"))), F.transform(rest, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))))
    one = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["key"] == e["key"]))
    odd = F.coalesce(F.trim(given) != "", F.lit(False)) & ~F.coalesce(F.trim(given).startswith("{"), F.lit(False))
    reason = F.when(pairs.isNull(), "not a record").when(field["source_ref"].isNull(), "no reference").when(text.isNull(), "no text").when(odd, "metadata is no object")
    return held.select(*own, F.coalesce(field["source"], F.lit("unstructured_fir")).alias("source"), field["source_ref"].alias("source_ref"), text.alias("text"), F.coalesce(field["jurisdiction"], F.lit("UNSPECIFIED")).alias("jurisdiction"), F.map_from_entries(one).alias("metadata"), reason.alias("reason"))
