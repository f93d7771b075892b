"""Headers of uploaded files matched to fields: by a known spelling, else by the likeness of their sorted words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.sources import FIELDS

ACCEPT, SUGGEST = 86, 72
RESULT = "array<struct<pos: int, header: string, field: string, method: string, score: int, suggested: string>>"


def normal(header: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", (header or "").lower().replace("&", " and ")).strip()


@lru_cache(50_000)
def likeness(a: str, b: str) -> int:
    """100 times the share of two texts' characters, their words sorted, that a longest common subsequence covers; cut to a whole number."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return int(200 * row[-1] / (len(a) + len(b))) if a or b else 100


_KNOWN = {normal(spelling).replace(" ", ""): field for field, (_, spellings) in FIELDS.items() for spelling in spellings}
_LABELS = [(field, x) for field, (label, _) in FIELDS.items() for x in (field.replace("_", " "), label)]
_LABELS += [(field, spelling) for field, (_, spellings) in FIELDS.items() for spelling in spellings]


def match(headers: list[str | None]) -> list[tuple]:
    """Position (from 1), header, field, method, score, suggested field. A field is claimed once, by the first column that fits."""
    claimed: set[str] = set()
    out = []
    for pos, header in enumerate(headers, 1):
        key = normal(header)
        field = _KNOWN.get(key.replace(" ", ""))
        if key and field and field not in claimed:
            claimed.add(field)
            out.append((pos, header, field, "alias", 100, None))
            continue
        best, score = None, 0
        for other, label in _LABELS if key else ():
            if other not in claimed and (found := likeness(key, label)) > score:
                best, score = other, found
        if best and score >= ACCEPT:
            claimed.add(best)
            out.append((pos, header, best, "fuzzy", score, None))
        else:
            out.append((pos, header, None, "none", score, best if score >= SUGGEST else None))
    return out


def header_mapping(headers: DataFrame) -> DataFrame:
    """file_id, pos, header, field, method, score, suggested of headers(file_id, pos, header).

    Files with the same headers are matched once; a file's headers are one row, so they should be some hundreds at most.
    """
    files = headers.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "header"))), lambda x: x["header"]).alias("headers"))

    @F.pandas_udf(RESULT)
    def matched(lists: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("pos", "header", "field", "method", "score", "suggested"), row)) for row in match(list(x))] for x in lists])

    distinct = files.select("headers").distinct().withColumn("m", matched("headers"))
    return files.join(distinct.hint("shuffle_hash"), "headers").select("file_id", F.inline("m"))
