"""Rules of single values as Column functions: validity, codes, dates, mentions in prose, confidence. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a place and the jurisdiction code that each stands for.
JURISDICTIONS = {
    "del": "DEL", "delhi": "DEL", "new delhi": "DEL", "nct": "DEL",
    "mum": "MUM", "mumbai": "MUM", "bombay": "MUM",
    "blr": "BLR", "bengaluru": "BLR", "bangalore": "BLR",
    "hyd": "HYD", "hyderabad": "HYD",
    "chn": "CHN", "chennai": "CHN",
    "kol": "KOL", "kolkata": "KOL", "calcutta": "KOL",
    "pun": "PUN", "pune": "PUN",
    "jai": "JAI", "jaipur": "JAI",
    "amd": "AMD", "ahmedabad": "AMD",
}
# Base confidence of a model's labels, and of the rules' kinds.
LABEL_CONFIDENCE = {"PERSON": 0.97, "ORG": 0.93, "GPE": 0.91, "LOC": 0.91, "FAC": 0.88, "EVENT": 0.86}
RULE_CONFIDENCE = {"person": 0.88, "location": 0.86, "organisation": 0.84, "event": 0.82}
LEAST_ELIGIBLE = 0.85
# Formats of dates, tried in this order.
FINDING_DATES = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy")
IMPORT_DATES = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy")
DATE_KEYS, END_KEYS = ("event_date", "occurred_at", "date", "valid_from"), ("event_end", "valid_to")
# What identifiers look like in text, and the words before them that decide.
PHONE = r"(?:\+91[-\s]?\d{5}[-\s]?\d{5}|\+91[-\s]?\d{10}|\b[6-9]\d{9}\b)"
NOT_A_PHONE_AFTER = r"(?i)\b(?:case|fir|crime|dated|date|no\.?|number|ref)\b"
ACCOUNT, NUMERIC_ACCOUNT = r"(?i:\bACC\d{6,}\b)", r"\b\d{9,18}\b"
ACCOUNT_BEFORE = r"(?i)\b(?:account|a/c|acct|bank\s+account)\b"
DATE_IN_TEXT = r"(?i)\b(?:dated|on|occurred)\s+(\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}-\d{2}-\d{2})"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean(c: Column) -> Column:
    """Trimmed; null for an empty cell or a word for nothing."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def phone_valid(c: Column) -> Column:
    """Ten digits, or twelve and more that begin with 91; signs between them do not count."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return (F.length(digits) == 10) | ((F.length(digits) >= 12) & digits.startswith("91"))


def jurisdiction_code(c: Column) -> Column:
    """The code of a known spelling, also without its signs and blanks; else short names in capitals, others as they are."""
    text = clean(c)
    known = _map(JURISDICTIONS)
    compact = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(known, F.lower(text)), F.try_element_at(known, compact), F.when(F.length(text) <= 5, F.upper(text)).otherwise(text))


def _date(c: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits; one is tried only where the text has the sign between its parts."""
    sign = lambda f: next(x for x in f if not x.isalpha())
    return F.coalesce(*[F.when(c.contains(sign(f)), F.call_function("try_to_date", c, F.lit(f))) for f in formats])


def import_date(c: Column) -> Column:
    """A date; an ISO form must be right as it stands, others are read with the day first where that can be."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(text, ("yyyy-MM-dd",))).otherwise(_date(text, IMPORT_DATES))


def finding_date(c: Column) -> Column:
    """ISO text of a date; text in no known form stays as it is; null for nothing."""
    text = F.trim(c)
    return F.when(text != "", F.coalesce(F.date_format(_date(text, FINDING_DATES), "yyyy-MM-dd"), text))


def case_timestamp(c: Column) -> Column:
    """A time for ordering, without a zone in UTC (the session's zone must be UTC); null for what is none."""
    return F.call_function("try_to_timestamp", clean(c))


def temporal_bounds(metadata: Column, record: dict[str, Column], text: Column) -> Column:
    """struct(valid_from, valid_to): from the metadata map, else the record's dates, else a date in the text; ends from metadata alone."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    of_map = lambda k: given(F.try_element_at(metadata, F.lit(k)))
    in_text = given(F.regexp_extract(text, DATE_IN_TEXT, 1))
    first = F.coalesce(*map(of_map, DATE_KEYS), *[given(record[k]) for k in DATE_KEYS if k in record], in_text)
    return F.struct(finding_date(first).alias("valid_from"), finding_date(F.coalesce(*map(of_map, END_KEYS))).alias("valid_to"))


def _let(value: Column, of) -> Column:
    """of(value) with value worked out once: expressions with lambdas are evaluated as written, each mention of a column anew."""
    return F.element_at(F.transform(F.array(value), of), 1)


def places(text: Column, pattern: str) -> Column:
    """array<struct<value, start>>: every match of a pattern and where it begins (from 0), by one running sum over the texts between."""
    kind = "array<struct<value:string,start:int>>"
    state = f"struct<at:int,out:{kind}>"

    def step(sofar: Column, x: Column) -> Column:
        return _let(sofar["at"] + F.length(x["gap"]), lambda start: F.struct((start + F.length(x["value"])).alias("at"), F.concat(sofar["out"], F.array(F.struct(x["value"].alias("value"), start.alias("start")))).alias("out")).cast(state))

    def several(found: Column) -> Column:
        steps = F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")).cast(state)
        return F.aggregate(steps, begin, step)["out"]

    def placed(found: Column) -> Column:
        one = F.array(F.struct(F.element_at(found, 1).alias("value"), F.length(F.element_at(F.split(text, pattern, 2), 1)).alias("start"))).cast(kind)
        return F.when(F.size(found) == 0, F.array().cast(kind)).when(F.size(found) == 1, one).otherwise(several(found))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def is_phone(text: Column, x: Column) -> Column:
    """Whether a phone of places() counts in prose: no word for a case, date or number within 32 characters before, no digit beside it."""
    digit = lambda at: F.substring(text, at, F.lit(1)).rlike("[0-9]")
    beside = ((x["start"] > 0) & digit(x["start"])) | digit(x["start"] + F.length(x["value"]) + 1)
    return ~_before(text, x["start"], 32).rlike(NOT_A_PHONE_AFTER) & ~beside


def is_account(text: Column, x: Column) -> Column:
    """Whether a number of places() is an account in prose: a word for one within 48 characters before."""
    return _before(text, x["start"], 48).rlike(ACCOUNT_BEFORE)


def phone_mentions(text: Column) -> Column:
    """array<struct<value, start>> of phones in prose, +91 and ten digits."""
    named = lambda x: F.struct(F.concat(F.lit("+91"), F.right(F.regexp_replace(x["value"], "[^0-9]", ""), F.lit(10))).alias("value"), x["start"].alias("start"))
    return F.transform(F.filter(places(text, PHONE), lambda x: is_phone(text, x)), named)


def account_mentions(text: Column) -> Column:
    """array<struct<value, start>> of accounts in prose: ACC numbers, and 9 to 18 digits after a word for an account."""
    upper = lambda x: F.struct(F.upper(x["value"]).alias("value"), x["start"].alias("start"))
    numeric = F.filter(places(text, NUMERIC_ACCOUNT), lambda x: is_account(text, x))
    return F.concat(F.transform(places(text, ACCOUNT), upper), F.transform(numeric, upper))


def span_confidence(label: Column, start: Column, end: Column) -> Column:
    """A model's label's base confidence, a little less for spans of up to three characters."""
    base = F.coalesce(F.try_element_at(_map(LABEL_CONFIDENCE), label), F.lit(LEAST_ELIGIBLE))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(end - start <= 3, 0.02).otherwise(0.0))), 4)


def eligible(confidence: Column) -> Column:
    return confidence >= LEAST_ELIGIBLE
