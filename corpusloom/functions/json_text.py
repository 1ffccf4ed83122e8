"""Tolerant reading of JSON out of model answers, and the coercion of judge verdicts."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def _balanced(text: str, start: str, end: str) -> str | None:
    at = text.find(start)
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)) if at >= 0 else ():
        c = text[i]
        if quoted:
            quoted, skip = (skip or c != '"'), (c == "\\" and not skip)
        elif c == '"':
            quoted = True
        elif c in (start, end):
            depth += 1 if c == start else -1
            if not depth:
                return text[at : i + 1]
    return None


def first_json(text: str | None) -> str | None:
    """The first object or list that parses, of: fenced blocks, the whole text, the first balanced braces, the first balanced brackets."""
    if not text:
        return None
    for part in [*_FENCE.findall(text), text, _balanced(text, "{", "}"), _balanced(text, "[", "]")]:
        try:
            value = json.loads(part) if part else None
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(StringType())
def extract_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of ``first_json``: canonical JSON, null where nothing parses."""
    for s in parts:
        yield s.map(first_json)


def verdict(answer: Column) -> Column:
    """Struct of a judge's verdict: score 1 to 5, correct, confidence 0 to 1, claims, unsupported_rate (null without claims)."""
    j = extract_json(answer)
    text = lambda k: F.get_json_object(j, f"$.{k}")
    number = lambda k: text(k).try_cast("double")
    within = lambda k, a, b: F.when(number(k).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), number(k))))
    low = F.lower(F.trim(text("correct")))
    claims = F.slice(F.filter(F.from_json(text("claims"), "array<struct<claim:string,supported:boolean>>"), lambda x: F.length(F.trim(x["claim"])) > 0), 1, 10)
    wrong = F.size(F.filter(claims, lambda x: ~F.coalesce(x["supported"], F.lit(True))))
    return F.struct(
        F.round(within("score", 1.0, 5.0)).cast("int").alias("score"), F.when(low.isin("true", "t", "1", "yes"), True).when(low.isNotNull(), False).alias("correct"),
        within("confidence", 0.0, 1.0).alias("confidence"),
        claims.alias("claims"), F.when(F.size(claims) > 0, wrong / F.size(claims)).alias("unsupported_rate"))
