"""Fuzzy names: candidate pairs by shared blocks, their scores, a decision for each mention, and the whole cascade of resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.functions import spread_join, stored
from tracelink.functions.similarity import with_name_score, words

# Least scores of a resolved and of a candidate name, and the least lead over the second.
RESOLVED, CANDIDATE, LEAD, PROPOSED = 92.0, 85.0, 3.0, 3
IDENTIFIERS, NAMES, NEVER = ("phone", "vehicle", "bank_account", "ifsc"), ("person_name", "name", "person"), ("location", "organisation", "event")
#: Mentions and names of a block that meet in one cell; a larger block is dealt to a grid of cells.
CELL = 2000


def block_keys(name: Column) -> Column:
    """What a pair must share: a word, the sound of a word, or the first three letters of one."""
    each = F.filter(words(F.lower(name)), lambda w: w != "")
    made = F.transform(each, lambda w: F.array(F.concat(F.lit("w "), w), F.concat(F.lit("s "), F.soundex(w)), F.concat(F.lit("p "), F.substring(w, 1, 3))))
    return F.array_distinct(F.flatten(made))


def candidate_pairs(mentions: DataFrame, names: DataFrame, cell: int = CELL) -> DataFrame:
    """(mention, name): different pairs that share a block; no pair within a block is left out.

    mentions has the column mention, names the column name; nulls and texts without a word take no part. A block of more than
    `cell` mentions or names is a grid: a row goes to one line of it and meets every column, so no task holds a whole block. A
    pair that shares several blocks comes from the least of them.
    """
    sides = [d.where(F.size(block_keys(F.col(c))) > 0).select(c).distinct().withColumn("keys_of_" + c, block_keys(F.col(c))) for d, c in ((mentions, "mention"), (names, "name"))]
    rows = [stored(d.withColumn("key", F.explode(f"keys_of_{c}")), f"blocks-{c}") for d, c in zip(sides, ("mention", "name"))]
    lines = [d.groupBy("key").agg(F.ceil(F.count("*") / cell).cast("int").alias(f"{c}_lines")) for d, c in zip(rows, ("mention", "name"))]
    grid = stored(lines[0].join(lines[1].hint("merge"), "key"), "block-sizes")
    dealt = []
    for d, own, other in ((rows[0], "mention", "name"), (rows[1], "name", "mention")):
        d = d.join(grid.hint("merge"), "key")
        line = F.pmod(F.xxhash64(own), F.col(f"{own}_lines")).cast("int").alias(f"{own}_line")
        dealt.append(d.select("key", own, f"keys_of_{own}", line, F.explode(F.sequence(F.lit(0), F.col(f"{other}_lines") - 1)).alias(f"{other}_line")))
    pairs = dealt[0].join(dealt[1].hint("merge"), ["key", "mention_line", "name_line"])
    first = F.array_min(F.array_intersect("keys_of_mention", "keys_of_name"))
    return pairs.where(F.col("key") == first).select("mention", "name")


def name_scores(mentions: DataFrame, names: DataFrame, cell: int = CELL) -> DataFrame:
    """(mention, name, token_set, weighted, jaro, score) of all candidate pairs; the pairs are written before they are scored."""
    pairs = stored(candidate_pairs(mentions, names, cell), "name-pairs")
    return with_name_score(pairs, "mention", "name")


def name_decisions(mentions: DataFrame, scores: DataFrame, persons: DataFrame) -> DataFrame:
    """For each different mention its outcome: status, confidence (the best score), entity_id, proposed ids and how many persons
    are candidates. persons(person_id, name) may share names; of equal scores the lesser id comes first.
    """
    good = stored(scores.where(F.col("score") >= CANDIDATE).select("mention", "name", "score"), "name-candidates")
    kept = persons.where("person_id is not null and name is not null").select("person_id", "name").distinct()
    of_name = kept.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("person_id"))).where(F.col("k") <= PROPOSED).drop("k")
    owners = kept.groupBy("name").agg(F.count("*").alias("owners"))
    best = Window.partitionBy("mention").orderBy(F.desc("score"), "person_id")
    top = good.join(of_name.hint("merge"), "name").withColumn("k", F.row_number().over(best)).where(F.col("k") <= PROPOSED)
    ranked = top.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("k", "person_id", "score"))).alias("top"))
    counts = good.join(owners.hint("merge"), "name").groupBy("mention").agg(F.sum("owners").alias("candidates"))
    found = mentions.select("mention").distinct().join(ranked.hint("merge"), "mention", "left").join(counts.hint("merge"), "mention", "left")
    score = lambda k: F.try_element_at("top", F.lit(k))["score"]
    close = F.coalesce(score(1) - score(2) < LEAD, F.lit(False))
    status = F.when(F.col("top").isNull() | (score(1) < RESOLVED), "unresolved").when(close, "ambiguous").otherwise("resolved")
    out = found.withColumn("status", status)
    ids = F.transform("top", lambda t: t["person_id"])
    first = F.try_element_at("top", F.lit(1))["person_id"]
    proposed = F.when(F.col("status") == "ambiguous", ids).when(F.col("status") == "resolved", F.array(first)).otherwise(F.array().cast("array<string>"))
    return out.select("mention", "status", F.coalesce(score(1), F.lit(0.0)).alias("confidence"), F.when(F.col("status") == "resolved", first).alias("entity_id"), proposed.alias("proposed"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def review_fingerprint(kind: Column, value: Column, method: Column, jurisdiction: Column, ids: Column) -> Column:
    """What a reviewer's rejection is kept under."""
    parts = [F.lower(F.trim(kind)), F.lower(F.trim(value)), F.lower(F.trim(method)), F.upper(F.trim(F.coalesce(jurisdiction, F.lit("")))), F.array_join(F.array_sort(ids), ",")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _outcome(status: str | Column, method: str | Column, confidence: Column, entity: Column | None = None, proposed: Column | None = None, note: str | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(
        text(status).alias("status"), text(method).alias("method"), confidence.cast("double").alias("confidence"), (none if entity is None else entity).alias("entity_id"),
        (F.array().cast("array<string>") if proposed is None else proposed).alias("proposed"), (none if note is None else F.lit(note)).alias("note"),
    )


def owner_lists(registry: DataFrame) -> DataFrame:
    """(entity_type, value, owners): all owners of each identifier, in order; one row an identifier."""
    return registry.where("entity_id is not null").groupBy("entity_type", "value").agg(F.array_sort(F.collect_set("entity_id")).alias("owners"))


def with_owners(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows of resolve(..., lists=False) with all owners of an ambiguous identifier in `proposed`. The lists go to every row that asks for
    one, so group rows first where that can be."""
    found = spread_join(rows.withColumn("key_of_list", F.when(F.col("by_list"), F.col("value"))), lists.select("entity_type", F.col("value").alias("key_of_list"), "owners"), ["entity_type", "key_of_list"])
    return found.select(*[F.when(F.col("by_list"), F.col("owners")).otherwise(F.col("proposed")).alias(c) if c == "proposed" else F.col(c) for c in rows.columns if c != "by_list"])


def resolve(mentions: DataFrame, registry: DataFrame, persons: DataFrame, confirmed: DataFrame | None = None, rejected: DataFrame | None = None, cell: int = CELL, lists: bool = True) -> DataFrame:
    """mentions with status, method, confidence, entity_id, proposed and note: ineligible mentions stay unresolved; then the first
    that applies of a reviewer's confirmation, an exact identifier, and, for names, the fuzzy decision. Ambiguous ones are not merged.

    mentions(entity_type, value, eligible, confidence as own_confidence, jurisdiction, ...), registry(entity_type, value, entity_id),
    persons(person_id, name), confirmed(entity_type, value, entity_id; one row for each value, names are compared without case),
    rejected(fingerprint).
    Identifiers have confidence 0 to 1, names 0 to 100. Null values resolve to nothing. Only names that no confirmation settles
    are compared.
    The owners of an ambiguous identifier may be many, so no step carries them by mention; without lists they are left out and
    by_list says that owner_lists() has them under the mention's type and value.
    """
    kind, value = F.col("entity_type"), F.col("value")
    is_name, is_identifier = kind.isin(*NAMES), kind.isin(*IDENTIFIERS)
    own = [c for c in mentions.columns]
    keyed = mentions.withColumn("key_of_mention", F.when(is_name, F.lower(F.trim(value))).otherwise(value))
    keyed = stored(keyed, "mentions-keyed")
    spark = mentions.sparkSession
    confirmed = confirmed if confirmed is not None else spark.createDataFrame([], "entity_type string, value string, entity_id string")
    settled = confirmed.select("entity_type", F.when(is_name, F.lower(F.trim(value))).otherwise(value).alias("key_of_mention"), "entity_id").groupBy("entity_type", "key_of_mention").agg(F.max("entity_id").alias("confirmed_id"))
    of_value = stored(owner_lists(registry), "owner-lists")
    owners = of_value.select("entity_type", F.col("value").alias("key_of_mention"), F.size("owners").alias("n_owners"), F.col("owners")[0].alias("one_owner"))
    told = settled.join(owners.hint("merge"), ["entity_type", "key_of_mention"], "full")
    known = stored(spread_join(keyed, told, ["entity_type", "key_of_mention"], frequent=True), "mentions-known")
    open_ = known.where(F.col("eligible") & F.col("confirmed_id").isNull() & is_name).select(F.trim("value").alias("mention")).where("mention <> ''").distinct()
    open_ = stored(open_, "names-open")
    decided = stored(name_decisions(open_, name_scores(open_, persons.select("name"), cell), persons), "names-decided")
    fuzzy = decided.select(F.col("mention"), F.struct("status", "confidence", "entity_id", "proposed").alias("fuzzy"))
    joined = spread_join(known.withColumn("mention", F.when(is_name, F.trim("value"))), fuzzy, ["mention"])
    n, none = F.col("n_owners"), F.lit(0.0)
    exact = F.concat(F.lit("exact_"), kind)
    method = F.when(is_identifier, exact).when(is_name, "fuzzy_name").otherwise("none")
    outcome = (
        F.when(~F.col("eligible"), _outcome("unresolved", "none", F.coalesce("own_confidence", none)))
        .when(F.col("confirmed_id").isNotNull(), _outcome("resolved", method, F.when(is_identifier, 1.0).otherwise(100.0), F.col("confirmed_id"), F.array("confirmed_id"), "confirmed by a reviewer"))
        .when(is_identifier & (n == 1), _outcome("resolved", exact, F.lit(1.0), F.col("one_owner"), F.array("one_owner")))
        .when(is_identifier & (n > 1), _outcome("ambiguous", exact, F.lit(1.0)))
        .when(kind.isin(*NEVER), _outcome("unresolved", "none", F.coalesce("own_confidence", none)))
        .when(is_name & F.col("fuzzy").isNotNull(), _outcome(F.col("fuzzy.status"), "fuzzy_name", F.col("fuzzy.confidence"), F.col("fuzzy.entity_id"), F.col("fuzzy.proposed")))
        .otherwise(_outcome("unresolved", "none", none))
    )
    by_list = F.coalesce((F.col("status") == "ambiguous") & is_identifier, F.lit(False)).alias("by_list")
    out = joined.select(*own, outcome.alias("o"), (F.col("confirmed_id").isNotNull() & F.col("eligible")).alias("by_reviewer")).select(*own, "o.*", "by_reviewer").select("*", by_list)
    if rejected is not None:
        # one fingerprint for all mentions that are asked about in the same words; its lists of owners stay there
        asked = F.sha2(F.to_json(F.struct("entity_type", "value", "method", F.upper(F.trim(F.coalesce("jurisdiction", F.lit("")))).alias("place"), "proposed", "by_list")), 256)
        out = stored(out.withColumn("asked", F.when((F.col("status") != "unresolved") & ~F.col("by_reviewer"), asked)), "mentions-resolved")
        words_ = out.where("asked is not null").select("asked", "entity_type", "value", "method", "jurisdiction", "proposed", "by_list").dropDuplicates(["asked"])
        print_ = review_fingerprint(kind, value, F.col("method"), F.col("jurisdiction"), F.col("proposed"))
        prints = with_owners(words_, of_value).select("asked", print_.alias("fingerprint"))
        barred = prints.join(rejected.select("fingerprint").distinct().hint("merge"), "fingerprint", "left_semi").select("asked", F.lit(True).alias("barred"))
        out = spread_join(out, barred, ["asked"], frequent=True).withColumn("barred", F.coalesce("barred", F.lit(False)))
        changed = {"status": F.lit("unresolved"), "entity_id": F.lit(None).cast("string"), "note": F.lit("rejected by a reviewer")}
        out = out.select(*own, *[F.when(F.col("barred"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in ("status", "method", "confidence", "entity_id", "proposed", "note", "by_list")])
    out = out.drop("by_reviewer")
    return with_owners(out, of_value).select(*own, "status", "method", "confidence", "entity_id", "proposed", "note") if lists else out


def review_queue(resolved: DataFrame, decided: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """What a reviewer has to look at: one row for each fingerprint of the ambiguous mentions of resolve(), with its proposed ids, score,
    number of mentions and first reference. decided(fingerprint, status): reviews that are there; those that are not pending (confirmed
    or rejected) are not asked again. lists: owner_lists(), for mentions resolved without them; they meet groups of mentions, not mentions.
    """
    same = ["entity_type", "value", "method", "jurisdiction", "proposed", *(["by_list"] if lists is not None else [])]
    asked = resolved.where("status = 'ambiguous'").groupBy(*same).agg(F.min("source_ref").alias("first_ref"), F.max("confidence").alias("score"), F.count("*").alias("mentions"))
    asked = stored(asked, "reviews-asked")
    whole = lambda rows: rows if lists is None else with_owners(rows, lists)
    print_ = review_fingerprint(F.col("entity_type"), F.col("value"), F.col("method"), F.col("jurisdiction"), F.col("proposed")).alias("fingerprint")
    named = whole(asked.withColumn("asked_as", F.struct(*same))).select(print_, "asked_as", "first_ref", "score", "mentions")
    queue = named.groupBy("fingerprint").agg(F.min_by("asked_as", "first_ref").alias("r"), F.max("score").alias("score"), F.sum("mentions").alias("mentions"), F.min("first_ref").alias("first_ref"))
    queue = queue.select("fingerprint", "r.*", "score", "mentions", "first_ref")
    if decided is not None:
        queue = queue.join(decided.where("status <> 'pending'").select("fingerprint").distinct().hint("merge"), "fingerprint", "left_anti")
    return whole(queue).withColumn("value", F.trim("value"))
