"""Imports of tables: every row checked with reasons, duplicates found, a disposition given, accepted rows fanned out to the sources.

Columns that a table lacks count as empty. Row-wise checks work on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import rules, spread_join, stored
from tracelink.operators.names import resolve

# Fields of an upload; those of which a row needs one; those whose values tell rows of a file apart.
TARGETS = ("fir_id", "person_id", "name", "phone", "vehicle_no", "bank_account", "social_id", "jurisdiction", "home_city", "location", "date", "crime", "vehicle_type", "registered_city", "risk_group", "narrative_text", "source_ref")
IDENTITY = ("fir_id", "person_id", "name", "phone", "vehicle_no")
HASHED = ("crime", "date", "fir_id", "location", "name", "person_id", "phone", "vehicle_no")
OPEN = ("ready", "incomplete")
#: Rows of one identity that are numbered in one task; more of them are numbered in several runs.
RUN = 100_000


def split_row(rows: DataFrame, fields: dict[str, str], order: str) -> DataFrame:
    """rows under their fields' names, cleaned, and `unmapped`: a map of the other columns' values that are not empty."""
    chosen = {f: c for c, f in reversed(fields.items()) if c in rows.columns}
    rest = [c for c in rows.columns if c not in chosen.values() and c != order]
    text = lambda c: rules.clean(F.col(f"`{c}`").cast("string"))
    made = F.create_map(*[x for c in rest for x in (F.lit(c), text(c))]) if rest else F.expr("map()").cast("map<string,string>")
    return rows.select(order, *[(text(chosen[f]) if f in chosen else F.lit(None).cast("string")).alias(f) for f in TARGETS], F.map_filter(made, lambda k, v: v.isNotNull()).alias("unmapped"))


def identity_hash() -> Column:
    """SHA-256 of field=value over the eight fields that tell rows apart; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))) for c in HASHED]), 256)


def checked(rows: DataFrame, admin: bool = False, jurisdictions: tuple[str, ...] = ()) -> DataFrame:
    """Rows of split_row() with normal values, status, reasons (array of text) and original values of fields that are no good in `unmapped`.

    ready, or incomplete (nothing to tell it by, no date where one is given, no jurisdiction where the reader or a narrative needs
    one), invalid (a phone that is none), unauthorized (a jurisdiction that the reader does not have; no other reason is then told).
    """
    here = lambda c: F.col(c).isNotNull()
    # columns of their own: as expressions they would be worked out anew wherever they are named
    read = {"code_read": rules.jurisdiction_code(F.col("jurisdiction")), "date_read": rules.import_date(F.col("date")), "no_phone": here("phone") & ~rules.phone_valid(F.col("phone"))}
    rows, code, date = rows.withColumns(read), F.col("code_read"), F.col("date_read")
    identity = here(IDENTITY[0])
    for c in IDENTITY[1:]:
        identity |= here(c)
    told = here("narrative_text")
    bad_phone, bad_date = F.col("no_phone"), here("date") & date.isNull()
    nothing, outside = ~identity & ~told, here("jurisdiction") & F.lit(not admin) & ~F.coalesce(code.isin(*jurisdictions), F.lit(False))
    unscoped = ~here("jurisdiction") & told
    hidden = ~here("jurisdiction") & ~told & F.lit(not admin) & identity
    status = F.when(outside, "unauthorized").when(unscoped | hidden | nothing, "incomplete").when(bad_phone, "invalid").when(bad_date, "incomplete").otherwise("ready")
    because = [
        (nothing, F.lit("Not enough identity information.")), (bad_phone, F.concat(F.lit("Phone value '"), "phone", F.lit("' is not a recognisable format."))),
        (bad_date, F.concat(F.lit("Date '"), "date", F.lit("' could not be parsed."))), (unscoped, F.lit("Unstructured extraction requires a jurisdiction.")),
        (hidden, F.lit("Jurisdiction is missing.")),
    ]
    reasons = F.when(outside, F.array(F.lit("This record belongs to a jurisdiction outside your current access."))).otherwise(F.array_compact(F.array(*[F.when(c, text) for c, text in because])))
    kept = F.map_filter(F.create_map(F.lit("phone_original"), F.when(bad_phone, F.col("phone")), F.lit("date_original"), F.when(bad_date, F.col("date"))), lambda k, v: v.isNotNull())
    tight = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    phone = F.when(~bad_phone, F.concat(F.lit("+91"), F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10))))
    made = {
        "status": status, "reasons": reasons, "has_identity": identity, "has_narrative": told, "invalid_value": F.coalesce(bad_phone | bad_date, F.lit(False)),
        "unmapped": F.map_concat(F.map_filter("unmapped", lambda k, v: ~k.isin("phone_original", "date_original")), kept),
        "phone": phone, "date": F.date_format(date, "yyyy-MM-dd"), "jurisdiction": code, "vehicle_no": tight("vehicle_no"), "bank_account": tight("bank_account"),
    }
    return rows.withColumns(made).drop(*read)


def in_file_duplicates(rows: DataFrame, order: str) -> DataFrame:
    """Checked rows with earlier_row, for a ready or incomplete one whose identity has stood before: the last earlier row of it that was
    not itself taken for a duplicate (the first, or one that is invalid or not allowed).

    The rows of an identity are numbered in runs of RUN places, each in a task of its own; what runs before it hold comes from one
    row a run, so that an identity of a third of all rows (all the empty ones) is no single task. rows are read twice, each time only
    what is asked for, and should rest on a table.
    """
    # the hash's 32 bytes travel, not its 64 digits; never null, so that no filter makes it twice
    keyed = rows.withColumns({"identity": F.coalesce(F.unhex(identity_hash()), F.lit(b"")), "run_of_rows": F.floor(F.col(order) / RUN)})
    stays = F.when(~F.col("status").isin(*OPEN), F.col(order))
    runs = keyed.groupBy("identity", "run_of_rows").agg(F.min(order).alias("least"), F.max(stays).alias("last"))
    before = Window.partitionBy("identity").orderBy("run_of_rows").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("identity", "run_of_rows", F.min("least").over(Window.partitionBy("identity")).alias("first"), F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("identity", "run_of_rows").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.max(stays).over(inside))
    joined = near.join(runs.hint("merge"), ["identity", "run_of_rows"])
    earlier = F.when((F.col(order) > F.col("first")) & F.col("status").isin(*OPEN), F.greatest("first", "carried", "near"))
    return joined.withColumns({"earlier_row": earlier, "identity": F.lower(F.hex("identity"))}).drop("run_of_rows", "near", "first", "carried")


def assess(rows: DataFrame, order: str, cases: DataFrame, persons: DataFrame, admin: bool = False, jurisdictions: tuple[str, ...] = (), registry: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """Rows of split_row() with the whole verdict: status, reasons, earlier_row, possible_match and its method and confidence,
    importable, disposition, person_key, redacted. Nothing is ever merged.

    cases(fir_id) and persons(person_id, name, phone) are what is stored. A row with a stored case or person is a duplicate; one that
    is open, has no person_id and the phone or name of a stored person is possible_duplicate. With a registry (entity_type, value,
    entity_id) names that no one has go through the cascade too. skipped(order): rows that the reader leaves out. Only the
    checked rows are written; what is worked out from them is made where it is asked for.
    """
    sound = stored(checked(rows, admin, jurisdictions), "import-rows")
    first = in_file_duplicates(sound, order)
    known = lambda d, c, name: d.where(F.col(c).isNotNull()).select(F.col(c)).distinct().withColumn(name, F.lit(True))
    norm = F.concat(F.lit("+91"), F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10)))
    phones = persons.where("phone is not null").groupBy(norm.alias("phone")).agg(F.min("person_id").alias("phone_owner"))
    names = persons.where("name is not null").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.min("person_id").alias("name_owner"))
    out = first.withColumn("name_key", F.lower(F.trim("name")))
    for right, key in ((known(cases, "fir_id", "case_known"), "fir_id"), (known(persons, "person_id", "person_known"), "person_id"), (phones, "phone"), (names, "name_key")):
        out = spread_join(out, right, [key], by=order)
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    case_twice = is_("case_known") & (F.col("status") != "unauthorized")
    repeated = F.col("earlier_row").isNotNull()
    person_twice = is_("person_known") & (F.col("status") != "unauthorized") & ~repeated & ~case_twice
    taken = repeated | case_twice | person_twice
    owner = F.coalesce("phone_owner", "name_owner")
    free = ~taken & F.col("status").isin(*OPEN) & F.col("person_id").isNull()
    match = free & owner.isNotNull()
    unknown = free & owner.isNull() & F.col("name").isNotNull()
    out = out.withColumns({"repeated": repeated, "case_twice": case_twice, "person_twice": person_twice, "taken": taken, "match": match, "unknown": unknown, "owner": owner})
    if registry is not None:
        out = stored(out, "import-known")
        told = out.where("unknown").select(F.col(order).alias("row_of_name"), F.lit("person").alias("entity_type"), F.col("name").alias("value"), F.lit(True).alias("eligible"), F.lit(1.0).alias("own_confidence"), "jurisdiction")
        found = resolve(told, registry, persons).where("status <> 'unresolved'").select("row_of_name", F.col("entity_id").alias("fuzzy_id"), F.col("confidence").alias("fuzzy_score"), F.col("status").alias("fuzzy"))
        out = out.join(found.hint("merge"), out[order] == found["row_of_name"], "left")
    else:
        out = out.withColumns({"fuzzy_id": F.lit(None).cast("string"), "fuzzy_score": F.lit(None).cast("double"), "fuzzy": F.lit(None).cast("string")})
    alike = F.col("match") | F.col("fuzzy").isNotNull()
    status = F.when(F.col("taken"), "duplicate").when(alike, "possible_duplicate").otherwise(F.col("status"))
    more = [
        (F.col("repeated"), F.concat(F.lit("Exact duplicate of row "), (F.col("earlier_row") + 1).cast("string"), F.lit(" in this file."))),
        (F.col("case_twice"), F.concat(F.lit("FIR/Case ID "), "fir_id", F.lit(" already exists."))), (F.col("person_twice"), F.concat(F.lit("Person ID "), "person_id", F.lit(" already exists."))),
        (F.col("match") | (F.col("fuzzy") == "resolved"), F.lit("Possible match to an existing person.")), (F.col("fuzzy") == "ambiguous", F.lit("Ambiguous identity match.")),
    ]
    out = out.withColumns({
        "reasons": F.concat("reasons", F.array_compact(F.array(*[F.when(c, t) for c, t in more]))), "status": status,
        "possible_match": F.when(F.col("match"), F.col("owner")).otherwise(F.col("fuzzy_id")),
        "match_method": F.when(F.col("match") & F.col("phone_owner").isNotNull(), "exact_phone").when(F.col("match"), "exact_name").when(F.col("fuzzy").isNotNull(), "fuzzy_name"),
        "match_confidence": F.when(F.col("match") & F.col("phone_owner").isNotNull(), 1.0).when(F.col("match"), 0.95).otherwise(F.col("fuzzy_score")),
    })
    left_out = F.lit(False)
    if skipped is not None:
        out = out.join(skipped.select(F.col(skipped.columns[0]).alias("row_left_out")).distinct().hint("merge"), F.col(order) == F.col("row_left_out"), "left")
        left_out = F.col("row_left_out").isNotNull()
    has = F.lit(False)
    for c in IDENTITY:
        has |= F.col(c).isNotNull()
    usable, scoped = has | F.col("has_narrative"), F.lit(admin) | F.col("jurisdiction").isNotNull()
    importable = F.when(left_out, False).when(F.col("status").isin("ready", "possible_duplicate"), True).when(F.col("status") == "incomplete", usable & scoped & ~(F.col("has_narrative") & F.col("jurisdiction").isNull())).when(F.col("status") == "invalid", usable).otherwise(False)
    redacted = (F.col("status") == "unauthorized") & F.lit(not admin)  # nothing above makes a row unauthorized or takes it back
    done = out.withColumns({
        "importable": importable, "redacted": redacted, "disposition": F.when(left_out, "skipped").when(F.col("status").isin("ready", "possible_duplicate"), "import").otherwise("unresolved"),
        "status": F.when(left_out, "skipped").otherwise(F.col("status")), "reasons": F.when(left_out, F.array_append("reasons", F.lit("Investigator chose to skip this record."))).otherwise(F.col("reasons")),
    })
    own = [order, *TARGETS, "unmapped", "status", "reasons", "earlier_row", "possible_match", "match_method", "match_confidence", "importable", "disposition", "redacted", "has_narrative", "identity"]
    return with_person_key(done.select(*own), order, sound.withColumn("redacted", redacted))


def with_person_key(rows: DataFrame, order: str, plain: DataFrame | None = None) -> DataFrame:
    """rows with person_key: the person_id, else IMP- and the first row of the same name, phone and vehicle; none if all three are empty.
    plain: the same rows with these columns and `redacted` alone, where they cost less than rows."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    group = F.concat_ws("|", F.lower(empty("name")), empty("phone"), empty("vehicle_no"))
    in_group = lambda d: d.withColumn("person_group", F.when(F.col("person_id").isNull() & ~F.col("redacted") & (group != "||"), group))
    keyed = in_group(rows)
    first = in_group(rows if plain is None else plain).where("person_group is not null").groupBy("person_group").agg(F.min(order).alias("first_of_group"))
    joined = spread_join(keyed, first, ["person_group"], by=order)
    made = F.when(F.col("redacted"), F.lit(None)).otherwise(F.coalesce("person_id", F.when(F.col("first_of_group").isNotNull(), F.concat(F.lit("IMP-"), F.lpad(F.col("first_of_group").cast("string"), 4, "0")))))
    long = F.when(F.length(F.col("first_of_group").cast("string")) > 4, F.concat(F.lit("IMP-"), F.col("first_of_group").cast("string"))).otherwise(made)
    return joined.withColumn("person_key", F.when(F.col("person_id").isNull() & F.col("first_of_group").isNotNull() & ~F.col("redacted"), long).otherwise(made)).drop("person_group", "first_of_group")


def shown(assessed: DataFrame, order: str) -> DataFrame:
    """What the reader may see: of redacted rows only the place, the status and the reasons."""
    open_ = {order, "status", "reasons", "redacted", "importable", "disposition"}
    return assessed.select(*[F.col(c) if c in open_ else F.when(~F.col("redacted"), F.col(c)).alias(c) for c in assessed.columns])


def summary(assessed: DataFrame) -> DataFrame:
    """One row: rows by status, and whether anything stands in the way."""
    n = lambda s: F.count_if(F.col("status") == s)
    names = {"ready": "ready", "incomplete": "incomplete", "invalid": "invalid", "duplicates": "duplicate", "possible_duplicates": "possible_duplicate", "unauthorized": "unauthorized", "skipped": "skipped"}
    warned = n("incomplete") + n("possible_duplicate") + n("invalid") > 0
    return assessed.agg(F.count("*").alias("detected"), *[n(s).alias(c) for c, s in names.items()], (n("unauthorized") > 0).alias("blocking_unauthorized"), (F.count_if(F.col("disposition") == "unresolved") > 0).alias("blocking_unresolved"), warned.alias("can_continue_with_warnings"))


def fan_out(assessed: DataFrame, order: str, import_id: str, ingested_at: str | None = None, with_warnings: bool = False) -> dict[str, DataFrame]:
    """The rows of persons, fir, vehicles and entity_mapping that an import adds, each with its _import_id.

    Rows to import count (with_warnings: importable incomplete and invalid ones too). A person comes from its first row; a mapping
    row follows for the person and each of its phone, vehicle and account; each row with a case or vehicle gives one.
    """
    taken = F.col("disposition") == "import"
    if with_warnings:
        taken |= F.col("importable") & F.col("status").isin("incomplete", "invalid")
    short = import_id[:8]
    numbered = F.lpad(F.col(order).cast("string"), 4, "0")
    key = F.coalesce("person_id", F.when(F.col("person_key").startswith("IMP-"), F.concat(F.lit(f"IMP-{short}-"), F.regexp_extract("person_key", "([^-]*)$", 1))), F.col("person_key"), F.concat(F.lit(f"IMP-{short}-"), numbered))
    stamp = [F.lit(import_id).alias("_import_id"), F.lit(ingested_at).cast("string").alias("_ingested_at")]
    fields = ("name", "phone", "vehicle_no", "bank_account", "social_id", "home_city", "risk_group")
    rows = assessed.where(taken).select(order, key.alias("of_person"), "fir_id", "crime", "date", "location", *fields, "registered_city", "vehicle_type")
    rows = stored(rows, "import-taken")
    firsts = rows.groupBy("of_person").agg(F.min_by(F.struct(*fields), order).alias("first"))
    persons = firsts.select(F.col("of_person").alias("person_id"), F.coalesce("first.name", "of_person").alias("name"), *[F.col(f"first.{c}").alias(c) for c in fields[1:]], *stamp)
    persons = stored(persons, "import-persons")
    pairs = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(c).alias("source_id")) for t, c in (("person", "person_id"), ("phone", "phone"), ("vehicle", "vehicle_no"), ("bank_account", "bank_account"))])
    mapping = persons.select(F.col("person_id").alias("entity_id"), F.inline(pairs), F.lit("data_import").alias("source"), stamp[0]).where("source_id is not null")
    fir = rows.where("fir_id is not null").select("fir_id", F.col("of_person").alias("person_id"), "crime", "date", "location", *stamp)
    vehicles = rows.where("vehicle_no is not null").select(F.col("of_person").alias("person_id"), "vehicle_no", "registered_city", "vehicle_type", stamp[0])
    return {"persons": persons, "fir": fir, "vehicles": vehicles, "entity_mapping": mapping}
