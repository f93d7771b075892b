"""The property graph from one declarative table: which nodes and relations each source yields, with keys, properties and provenance.

A source is scanned once: its templates become one array of structs, which is filled, filtered and exploded. A template whose key
or one of whose endpoints is missing yields nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("source", "source_ref", "content_hash", "ingested_at", "extraction_method", "confidence", "valid_from", "valid_to", "jurisdiction", "created_by")
MANDATORY = ("source_ref", "extraction_method", "confidence", "valid_from", "valid_to", "ingested_at", "jurisdiction", "created_by")
CANONICAL_RELATIONS = ("CALLED", "USES", "TRANSACTED_WITH", "CO_ACCUSED_IN", "PRESENT_AT", "ASSOCIATED_WITH", "MEMBER_OF", "SHARES_IDENTIFIER")

# Properties that no two nodes of a label share.
CONSTRAINTS = (
    ("Person", "person_id"), ("Phone", "value"), ("Vehicle", "vehicle_no"), ("BankAccount", "account_id"), ("SocialAccount", "handle"),
    ("Location", "name"), ("FIR", "fir_id"), ("Crime", "name"), ("SurveillanceEvent", "event_id"),
    ("Account", "account_ref"), ("Organisation", "org_id"), ("Case", "case_no"), ("Incident", "incident_id"),
)
# The columns whose values name a record of a source, and the columns of each source.
NATURAL_KEYS = {
    "persons": ("person_id",), "vehicles": ("vehicle_no",), "cdr": ("caller_id", "receiver_id", "timestamp"),
    "finance": ("sender_id", "receiver_id", "date", "amount"), "fir": ("fir_id",), "social": ("user_id", "connected_user_id", "date", "interaction_type"),
    "surveillance": ("event_id",), "entity_mapping": ("entity_id", "entity_type", "source", "source_id"),
}
COLUMNS = {
    "persons": ("person_id", "name", "phone", "vehicle_no", "bank_account", "social_id", "home_city", "risk_group"),
    "vehicles": ("vehicle_no", "person_id", "registered_city", "vehicle_type"),
    "cdr": ("caller_id", "receiver_id", "caller_phone", "receiver_phone", "timestamp", "duration_sec", "call_type"),
    "finance": ("sender_id", "receiver_id", "sender_account", "receiver_account", "amount", "date"),
    "fir": ("fir_id", "person_id", "crime", "date", "location"),
    "social": ("user_id", "connected_user_id", "user_handle", "connected_handle", "interaction_type", "date"),
    "surveillance": ("event_id", "person_id", "location", "timestamp", "event_type", "source", "vehicle_no"),
    "entity_mapping": ("entity_id", "entity_type", "source", "source_id"),
}


def phone(c: str) -> str:
    """SQL for a phone in its normal form: +91 and ten digits where the digits allow it, else without blanks."""
    digits = f"regexp_replace({c}, '[^0-9]', '')"
    return f"CASE WHEN length({digits}) >= 12 AND {digits} LIKE '91%' THEN '+91' || right({digits}, 10) WHEN length({digits}) = 10 THEN '+91' || {digits} ELSE regexp_replace({c}, '\\\\s+', '') END"


def plate(c: str) -> str:
    """SQL for a vehicle, an account or a branch code: capitals without blanks."""
    return f"upper(regexp_replace({c}, '\\\\s+', ''))"


@dataclass(frozen=True)
class Node:
    """A node: label, key property, SQL of the key's value, properties as SQL. plain: without provenance. where: SQL of a condition."""

    label: str
    key: str
    value: str
    props: dict[str, str] = field(default_factory=dict)
    plain: bool = False
    where: str = "true"


@dataclass(frozen=True)
class Relation:
    """A relation between two ends (label, key, SQL of the value). ref: what follows the record's id in source_ref. type: SQL text or a name."""

    type: str
    start: tuple[str, str, str]
    end: tuple[str, str, str]
    ref: str = ""
    props: dict[str, str] = field(default_factory=dict)
    valid_from: str = "null"
    where: str = "true"


def _person(c: str) -> tuple[str, str, str]:
    return "Person", "person_id", c


def _owned(label: str, key: str, value: str, relation: str, owner: str, ref: str = "", plain: bool = False, props: dict[str, str] | None = None, where: str = "true") -> list:
    """A thing and its relation from the person that has it."""
    return [Node(label, key, value, props or {}, plain, where), Relation(relation, _person(owner), (label, key, value), ref, where=where)]


def _used(label: str, key: str, value: str) -> list:
    return [Node(label, key, value), Relation("USES", _person("person_id"), (label, key, value), props={"attribution_basis": "'persons_source'"})]


def _mapped(kind: str, label: str, key: str, value: str, relation: str) -> list:
    return _owned(label, key, value, relation, "entity_id", props={"mapping_source": "source"}, where=f"lower(trim(entity_type)) = '{kind}'")


def _needing(condition: str, *templates: Node | Relation) -> list[Node | Relation]:
    return [replace(t, where=f"({t.where}) AND {condition}") for t in templates]


#: The templates of each source: those of the first form of the graph, then those of the canonical one.
MAPPING: dict[str, list[Node | Relation]] = {
    "persons": _needing(
        "person_id <> ''",
        Node("Person", "person_id", "person_id", {"name": "name", "home_city": "home_city", "risk_group": "risk_group"}),
        *_owned("Phone", "value", phone("phone"), "HAS_PHONE", "person_id"),
        *_owned("BankAccount", "account_id", plate("bank_account"), "HAS_ACCOUNT", "person_id"),
        *_owned("SocialAccount", "handle", "trim(social_id)", "HAS_SOCIAL_ACCOUNT", "person_id"),
        *_owned("Vehicle", "vehicle_no", plate("vehicle_no"), "OWNS", "person_id"),
        *_used("Phone", "msisdn", phone("phone")), *_used("Vehicle", "registration_no", plate("vehicle_no")), *_used("Account", "account_ref", plate("bank_account")),
    ),
    "vehicles": _owned("Vehicle", "vehicle_no", plate("vehicle_no"), "OWNS", "person_id", props={"registered_city": "registered_city", "vehicle_type": "vehicle_type"}, where="person_id <> ''"),
    "entity_mapping": _needing(
        "entity_id <> '' AND source_id <> ''",
        Node("Person", "person_id", "entity_id", where="lower(trim(entity_type)) = 'person'"),
        *_mapped("phone", "Phone", "value", phone("source_id"), "HAS_PHONE"), *_mapped("vehicle", "Vehicle", "vehicle_no", plate("source_id"), "OWNS"),
        *_mapped("bank_account", "BankAccount", "account_id", plate("source_id"), "HAS_ACCOUNT"), *_mapped("social_account", "SocialAccount", "handle", "trim(source_id)", "HAS_SOCIAL_ACCOUNT"),
    ),
    "cdr": [
        Node("Person", "person_id", "caller_id", plain=True, where="receiver_id <> ''"), Node("Person", "person_id", "receiver_id", plain=True, where="caller_id <> ''"),
        *_owned("Phone", "value", phone("caller_phone"), "HAS_PHONE", "caller_id", ":caller_phone", True, where="receiver_id <> ''"),
        *_owned("Phone", "value", phone("receiver_phone"), "HAS_PHONE", "receiver_id", ":receiver_phone", True, where="caller_id <> ''"),
        Relation("CALLED", _person("caller_id"), _person("receiver_id"), props={c: c for c in ("timestamp", "duration_sec", "call_type", "caller_phone", "receiver_phone")}),
        Node("Phone", "msisdn", phone("caller_phone"), where="receiver_phone <> ''"), Node("Phone", "msisdn", phone("receiver_phone"), where="caller_phone <> ''"),
        Relation("CALLED", ("Phone", "msisdn", phone("caller_phone")), ("Phone", "msisdn", phone("receiver_phone")), valid_from="timestamp",
                 props={"call_count": "1", "total_duration": "duration_sec", "first_call": "timestamp", "last_call": "timestamp", "direction": "'outbound'"}),
    ],
    "finance": [
        Node("Person", "person_id", "sender_id", plain=True, where="receiver_id <> ''"), Node("Person", "person_id", "receiver_id", plain=True, where="sender_id <> ''"),
        *_owned("BankAccount", "account_id", plate("sender_account"), "HAS_ACCOUNT", "sender_id", ":sender_account", True, where="receiver_id <> ''"),
        *_owned("BankAccount", "account_id", plate("receiver_account"), "HAS_ACCOUNT", "receiver_id", ":receiver_account", True, where="sender_id <> ''"),
        Relation("TRANSFERRED_MONEY_TO", _person("sender_id"), _person("receiver_id"), props={c: c for c in ("amount", "date", "sender_account", "receiver_account")}),
        Node("Account", "account_ref", plate("sender_account"), where="receiver_account <> ''"), Node("Account", "account_ref", plate("receiver_account"), where="sender_account <> ''"),
        Relation("TRANSACTED_WITH", ("Account", "account_ref", plate("sender_account")), ("Account", "account_ref", plate("receiver_account")), valid_from="date", props={"amount": "amount", "txn_ref": "record_id", "txn_datetime": "date"}),
    ],
    "fir": [
        Node("FIR", "fir_id", "fir_id", {"date": "date"}, where="person_id <> ''"), Node("Person", "person_id", "person_id", plain=True, where="fir_id <> ''"),
        Node("Crime", "name", "trim(crime)", where="fir_id <> '' AND person_id <> ''"), Relation("FOR_CRIME", ("FIR", "fir_id", "fir_id"), ("Crime", "name", "trim(crime)"), ":crime", where="person_id <> ''"),
        Node("Location", "name", "trim(location)", {"location_id": "trim(location)"}, where="fir_id <> '' AND person_id <> ''"),
        Relation("AT_LOCATION", ("FIR", "fir_id", "fir_id"), ("Location", "name", "trim(location)"), ":location", where="person_id <> ''"),
        Relation("INVOLVED_IN", _person("person_id"), ("FIR", "fir_id", "fir_id")),
        Node("Case", "case_no", "fir_id", {"fir_no": "fir_id"}, where="person_id <> ''"), Node("Incident", "incident_id", "fir_id || ':incident'", {"type": "crime", "occurred_at": "date", "case_no": "fir_id"}, where="person_id <> ''"),
        Relation("CO_ACCUSED_IN", _person("person_id"), ("Case", "case_no", "fir_id"), valid_from="date"),
    ],
    "social": [
        Node("Person", "person_id", "user_id", plain=True, where="connected_user_id <> ''"), Node("Person", "person_id", "connected_user_id", plain=True, where="user_id <> ''"),
        *_owned("SocialAccount", "handle", "trim(user_handle)", "HAS_SOCIAL_ACCOUNT", "user_id", ":user_handle", True, where="connected_user_id <> ''"),
        *_owned("SocialAccount", "handle", "trim(connected_handle)", "HAS_SOCIAL_ACCOUNT", "connected_user_id", ":connected_handle", True, where="user_id <> ''"),
        Relation("coalesce('SOCIAL_' || upper(nullif(interaction_type, '')), 'INTERACTED_WITH')", _person("user_id"), _person("connected_user_id"), props={c: c for c in ("date", "interaction_type", "user_handle", "connected_handle")}),
        Relation("ASSOCIATED_WITH", _person("user_id"), _person("connected_user_id"), valid_from="date", props={"association_type": "interaction_type", "observed_by": "'social'"}),
    ],
    "surveillance": [
        Node("SurveillanceEvent", "event_id", "event_id", {"timestamp": "timestamp", "event_type": "event_type", "event_source": "source", "vehicle_no": "vehicle_no"}, where="person_id <> ''"),
        Node("Person", "person_id", "person_id", plain=True, where="event_id <> ''"),
        *_owned("Vehicle", "vehicle_no", plate("vehicle_no"), "OWNS", "person_id", ":vehicle_no", True, where="event_id <> ''"),
        Relation("OBSERVED_AT", _person("person_id"), ("SurveillanceEvent", "event_id", "event_id")),
        Node("Location", "name", "trim(location)", {"location_id": "trim(location)"}, where="person_id <> ''"),
        Relation("AT_LOCATION", ("SurveillanceEvent", "event_id", "event_id"), ("Location", "name", "trim(location)"), ":event_location", where="person_id <> ''"),
        Relation("PRESENT_AT", _person("person_id"), ("Location", "name", "trim(location)"), ":present_at", {"timestamp": "timestamp", "event_type": "event_type"}, where="event_id <> ''"),
        Relation("PRESENT_AT", _person("person_id"), ("Location", "name", "trim(location)"), valid_from="timestamp", props={"observed_at": "timestamp", "observation_type": "event_type"}),
        Node("Vehicle", "registration_no", plate("vehicle_no"), where="person_id <> '' AND trim(location) <> ''"),
        Relation("PRESENT_AT", ("Vehicle", "registration_no", plate("vehicle_no")), ("Location", "name", "trim(location)"), valid_from="timestamp", props={"observed_at": "timestamp", "observation_type": "event_type"}, where="person_id <> ''"),
    ],
}

_ENDS = ("from_label", "from_key", "from_value", "to_label", "to_key", "to_value")
_FIELDS = ("kind", "label", "key_property", "key_value", "rel_type", *_ENDS, "source_ref", "valid_from")


def with_record(rows: DataFrame, source: str, order: str, ingested_at: str | None = None) -> DataFrame:
    """rows with record_id (the natural key, else the place in `order`), content_hash (of all columns but `order`, sorted, null told
    from empty) and ingested_at. Columns of the source that rows lack are null."""
    filled = rows.withColumns({c: F.lit(None).cast("string") for c in (*COLUMNS[source], "jurisdiction") if c not in rows.columns})
    text = lambda c: F.col(c).cast("string")
    keys = [text(c) for c in NATURAL_KEYS[source]]
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole &= k.isNotNull()
    data = F.to_json(F.struct(*[text(c).alias(c) for c in sorted(rows.columns) if c != order]), {"ignoreNullFields": "false"})
    named = F.when(whole, F.concat_ws(":", F.lit(source), *keys)).otherwise(F.concat(F.lit(f"{source}:row:"), text(order)))
    return filled.withColumns({"record_id": named, "content_hash": F.sha2(F.concat(data, F.lit(source)), 256), "ingested_at": F.lit(ingested_at).cast("string")})


def _fixed(t: Relation) -> bool:
    """Whether a relation's type is a name, and not SQL of its own."""
    return t.type.isupper() and t.type.replace("_", "").isalpha()


def _struct(t: Node | Relation) -> Column:
    text = lambda sql: F.expr(sql).cast("string")
    none = F.lit(None).cast("string")
    filled = lambda c: F.when(F.trim(c) != "", c)
    props = F.map_filter(F.create_map(*[x for k, v in t.props.items() for x in (F.lit(k), text(v))]) if t.props else F.expr("map()").cast("map<string,string>"), lambda k, v: v.isNotNull())
    if isinstance(t, Node):
        own = [F.lit("node"), F.lit(t.label), F.lit(t.key), filled(text(t.value)), *[none] * 7, none if t.plain else F.col("record_id"), none]
    else:
        named = F.lit(t.type) if _fixed(t) else text(t.type)
        ends = [x for label, key, value in (t.start, t.end) for x in (F.lit(label), F.lit(key), filled(text(value)))]
        own = [F.lit("relation"), none, none, none, named, *ends, F.concat("record_id", F.lit(t.ref)), text(t.valid_from)]
    made = F.struct(*[c.cast("string").alias(n) for c, n in zip(own, _FIELDS)], props.alias("properties"))
    return F.when(F.expr(t.where), made)


def graph_rows(rows: DataFrame, source: str, order: str = "ord", ingested_at: str | None = None, kind: str | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes and relations of one source's rows in plan order (record_ord, place), each with properties (map of text; null ones left
    out) and the ten columns of provenance; plain nodes have none. kind: only "node" or "relation", placed among themselves; types: only
    relations of these types. A row yields up to some dozen, so rows are dealt to all tasks first."""
    wanted = [t for t in MAPPING[source] if kind is None or isinstance(t, Node) == (kind == "node")]
    if types is not None:
        wanted = [t for t in wanted if isinstance(t, Relation) and (t.type in types or not _fixed(t))]
    if not wanted:
        wanted, rows = MAPPING[source], rows.limit(0)
    rows = rows.repartition(F.col(order))
    made = F.filter(F.array(*map(_struct, wanted)), lambda x: x.isNotNull() & F.when(x["kind"] == "node", x["key_value"].isNotNull()).otherwise(x["from_value"].isNotNull() & x["to_value"].isNotNull()))
    told = with_record(rows, source, order, ingested_at).select(F.col(order).alias("record_ord"), "record_id", "content_hash", "ingested_at", F.col("jurisdiction").cast("string").alias("jurisdiction"), F.posexplode(made).alias("place", "x"))
    given = F.col("x.source_ref").isNotNull()
    values = {
        "source": F.when(given, source), "source_ref": F.col("x.source_ref"), "content_hash": F.when(given, F.col("content_hash")), "ingested_at": F.when(given, F.col("ingested_at")),
        "extraction_method": F.when(given, "structured"), "confidence": F.when(given, 1.0), "valid_from": F.col("x.valid_from"), "valid_to": F.lit(None).cast("string"),
        "jurisdiction": F.when(given, F.col("jurisdiction")), "created_by": F.when(given, "system"),
    }
    rest = [F.col(f"x.{c}").alias(c) for c in _FIELDS[:-2]]
    out = told.select(F.lit(source).alias("of_source"), "record_ord", "place", "record_id", *rest, F.col("x.properties").alias("properties"), *[v.alias(k) for k, v in values.items()])
    return out if types is None else out.where(F.col("rel_type").isin(*types))


def shared_identifier_rows(people: DataFrame) -> DataFrame:
    """SHARES_IDENTIFIER for every pair of persons with one phone, vehicle or account, the earlier row (ord) first. One row of
    graph_rows() for each pair: the reference's own result, quadratic in the owners of a value, so what a pair has from its earlier
    row alone is made before rows meet."""
    rows = with_record(people, "persons", "ord")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(v).alias("value")) for k, v in (("phone", phone("phone")), ("vehicle", plate("vehicle_no")), ("account", plate("bank_account")))])
    long = rows.select("person_id", "ord", "record_id", "content_hash", "ingested_at", F.inline(kinds)).where("value <> '' and person_id <> ''")
    left, right = long.withColumn("ref", F.concat_ws(":", "record_id", "kind", "value")), long.select("kind", "value", F.col("person_id").alias("other"), F.col("ord").alias("other_ord"))
    pairs = left.join(right.hint("merge"), ["kind", "value"]).where("ord < other_ord")
    none = F.lit(None).cast("string")
    ends = [F.lit("Person"), F.lit("person_id"), F.col("person_id"), F.lit("Person"), F.lit("person_id"), F.col("other")]
    own = [F.lit("relation"), none, none, none, F.lit("SHARES_IDENTIFIER"), *ends]
    values = {"source": F.lit("persons"), "source_ref": F.col("ref"), "content_hash": F.col("content_hash"), "ingested_at": F.col("ingested_at"), "extraction_method": F.lit("inferred"), "confidence": F.lit(0.95), "valid_from": none, "valid_to": none, "jurisdiction": none, "created_by": F.lit("system")}
    place = F.hash("kind", "other")
    return pairs.select(F.lit("shared").alias("of_source"), F.col("ord").alias("record_ord"), place.alias("place"), "record_id", *[c.alias(n) for c, n in zip(own, _FIELDS[:-2])], F.create_map(F.lit("shared_type"), "kind", F.lit("shared_value"), "value").alias("properties"), *[v.alias(k) for k, v in values.items()])


NODE = ["label", "key_property", "key_value"]


def _placed_nodes(rows: DataFrame, ranks: dict[str, int] | None) -> DataFrame:
    ranks = ranks or {s: i for i, s in enumerate([*MAPPING, "shared"])}
    rank = F.create_map(*[x for s, i in ranks.items() for x in (F.lit(s), F.lit(i))])
    at = F.struct(F.try_element_at(rank, F.col("of_source")).alias("rank"), F.col("record_ord").cast("long").alias("o"), F.col("place").cast("long").alias("p"))
    return rows.where("kind = 'node'").withColumn("at", at)


def merged_properties(rows: DataFrame, ranks: dict[str, int] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each (label, key_property, key_value): properties where the last non-null value of each wins in plan order. only: names of
    those to keep; a node without any of them has no row."""
    nodes = _placed_nodes(rows, ranks)
    kept = [c for c in PROVENANCE if only is None or c in only]
    parts = ["properties", F.create_map("key_property", "key_value")]
    if kept:
        parts.insert(1, F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()))
    every = F.map_concat(*parts)
    held = every if only is None else F.map_filter(every, lambda k, v: k.isin(*only))
    last = nodes.select(*NODE, "at", F.explode(held).alias("name", "value")).groupBy(*NODE, "name").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy(*NODE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))


def merged_nodes(rows: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """merged_properties() with the different source_refs of each node in plan order. A node's references come together in one row."""
    refs = _placed_nodes(rows, ranks).where("source_ref is not null").groupBy(*NODE, "source_ref").agg(F.min("at").alias("at")).groupBy(*NODE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_ref"))), lambda x: x["source_ref"]).alias("source_refs"))
    return merged_properties(rows, ranks).join(refs.hint("merge"), NODE, "left")


def provenance_faults(rows: DataFrame) -> DataFrame:
    """Relations of a canonical type that cannot be explained: record_id, rel_type and the mandatory columns that are empty (only
    source_ref and extraction_method must not be)."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    faults = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in ("source_ref", "extraction_method")]))
    return rows.where((F.col("kind") == "relation") & F.col("rel_type").isin(*CANONICAL_RELATIONS)).select("record_id", "rel_type", faults.alias("faults")).where("size(faults) > 0")


def uniqueness_report(nodes: DataFrame) -> DataFrame:
    """One row for each of the 13 constraints: nodes with the property, its different values (an estimate from a mergeable sketch) and
    values_shared, how many values stand in two nodes or more.

    All constraints in one pass over merged nodes: each node yields the constraints of its label, and one aggregation counts them.
    """
    rules = F.create_map(*[x for label in dict.fromkeys(l for l, _ in CONSTRAINTS) for x in (F.lit(label), F.array(*[F.lit(p) for l, p in CONSTRAINTS if l == label]))])
    held = nodes.select("label", "key_property", "key_value", F.explode(F.try_element_at(rules, F.col("label"))).alias("property"), "properties")
    held = held.select("label", "property", "key_property", "key_value", F.try_element_at("properties", F.col("property")).alias("value")).where("value is not null")
    values = held.groupBy("label", "property", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("label", "property").agg(F.sum("n").alias("nodes"), F.hll_sketch_estimate(F.hll_sketch_agg("value", F.lit(14))).alias("values_about"), F.count_if(F.col("n") > 1).alias("values_shared"))
    every = nodes.sparkSession.createDataFrame(list(CONSTRAINTS), "label string, property string")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("nodes", "values_about", "values_shared")}
    return every.join(found.hint("merge"), ["label", "property"], "left").withColumns(zero)


def uniqueness_faults(nodes: DataFrame) -> DataFrame:
    """The values that break a constraint: label, property, value and the number of nodes that share it."""
    rules = F.create_map(*[x for label in dict.fromkeys(l for l, _ in CONSTRAINTS) for x in (F.lit(label), F.array(*[F.lit(p) for l, p in CONSTRAINTS if l == label]))])
    held = nodes.select("label", F.explode(F.try_element_at(rules, F.col("label"))).alias("property"), "properties")
    return held.select("label", "property", F.try_element_at("properties", F.col("property")).alias("value")).where("value is not null").groupBy("label", "property", "value").agg(F.count("*").alias("nodes")).where("nodes > 1")
