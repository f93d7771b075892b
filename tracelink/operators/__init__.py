"""Operators as SQL templates over named views, and how to run them.

`apply(spark, "g10_recurrence", mentions=df)` runs one operator on a user's own DataFrames; names in braces are its inputs.
`apply(spark, "i3_case_detail", {"case_id": "FIR7"}, cases=df, persons=df2)` gives a parameter a value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import spread_join, stored
from tracelink.functions.similarity import jaro_winkler
from tracelink.operators import extraction
from tracelink.operators.catalog import OPERATORS
from tracelink.sources import BINDINGS, TABLES


PARAMETER = r"\[\[(\w+): (.*?)\]\](?!\])"
#: Views that others read several times or join after an explode: written once, so that their sizes are known.
STORED = ("activity", "mentions", "name_keys")


def _entities(statements: DataFrame) -> DataFrame:
    return statements.select("source_ref", F.inline(extraction.entity_spans(F.col("text")))).select("source_ref", F.col("entity_type").alias("kind"), "value", "starts", "ends").distinct()


def _identifiers(statements: DataFrame) -> DataFrame:
    return statements.select("source_ref", F.inline(extraction.identifier_spans(F.col("text")))).select("source_ref", F.col("raw").alias("value"), "starts", "ends")


def resolved(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """The view `resolved`: mentions with how many owners each identifier has, and the owner where it is one. Rows of a frequent
    identifier are dealt to many tasks; mentions are read twice and should be stored."""
    key = ["entity_type", "value"]
    owners = registry.groupBy(*key).agg(F.count("*").alias("owners"), F.min("entity_id").alias("one"))
    known = F.col("owners").isNotNull()
    status = F.when((F.col("entity_type") == "ifsc") | ~known, "unresolved").when(F.col("owners") == 1, "resolved").otherwise("ambiguous")
    told = spread_join(mentions, owners, key, frequent=True)
    return told.select("source_ref", "jurisdiction", "event_date", *key, "owners", status.alias("status"), F.when(F.col("owners") == 1, F.col("one")).alias("entity_id"), F.when(known, F.expr("1.0")).otherwise(F.expr("0.0")).alias("confidence"))


#: Views that Spark builds from others by a function; their SQL is the oracle's.
BUILT = {"mentions": (("narratives",), extraction.mentions), "ner_spans": (("statements",), _entities), "identifier_spans": (("statements",), _identifiers), "resolved": (("mentions", "registry"), resolved)}


def inputs(template: str) -> list[str]:
    return sorted({n for _, n, _, _ in Formatter().parse(template) if n})


def dialect(text: str, spark: bool, given: Iterable[str] = ()) -> str:
    """A template in Spark's spelling or the oracle's; parameters in `given` become named markers, others their own value."""
    text = re.sub(r"<<(.*?) ## (.*?)>>", r"\1" if spark else r"\2", text, flags=re.S)
    text = re.sub(PARAMETER, lambda m: f":{m[1]}" if m[1] in given else m[2], text, flags=re.S)
    if spark:
        text = re.sub(r"(regexp_replace\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 'g'\)", r"\1)", text)
    return text.replace("EXPLODE(", "explode(" if spark else "unnest(")


def apply(spark: SparkSession, name: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """One operator on DataFrames given for its inputs. params are values for the template's parameters; others keep their own."""
    template, params = OPERATORS[name], params or {}
    unknown = params.keys() - {m[1] for m in re.finditer(PARAMETER, template, flags=re.S)}
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    spark.udf.register("jaro_winkler", jaro_winkler)
    return spark.sql(dialect(template, True, params), args=params or None, **views)


def bound(spark: SparkSession, sf_dir: str, template: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A template over the domain views of the tables in sf_dir."""
    made = {} if made is None else made
    for name in inputs(template):
        if name not in made:
            if name in TABLES:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            elif name in BUILT:
                sources, build = BUILT[name]
                made[name] = build(*[bound(spark, sf_dir, f"SELECT * FROM {{{source}}}", made) for source in sources])
            else:
                made[name] = bound(spark, sf_dir, BINDINGS[name], made)
            if name in STORED:
                made[name] = stored(made[name], name)
    if "jaro_winkler(" in template:
        spark.udf.register("jaro_winkler", jaro_winkler)
    return spark.sql(dialect(template, True), **{n: made[n] for n in inputs(template)})


def oracle(template: str) -> str:
    """The same query for the oracle: the views it needs come first as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in TABLES and name not in order:
            for n in inputs(BINDINGS[name]):
                visit(n)
            order.append(name)

    for n in inputs(template):
        visit(n)
    names = {n: n for n in [*TABLES, *BINDINGS]}
    ctes = ",\n".join(f"{n} AS ({dialect(BINDINGS[n], False).format(**names)})" for n in order)
    body = dialect(template, False).format(**names)
    return f"WITH {ctes}\n{body}" if ctes and not body.lstrip().startswith("WITH") else body if not ctes else f"WITH {ctes}, {body.lstrip()[4:]}"
