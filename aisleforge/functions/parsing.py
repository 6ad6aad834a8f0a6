"""Structured answers inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text: Column) -> Column:
    """The outermost {...} of a text, preferably inside a fenced block; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    found = F.when(F.length(fenced) > 0, fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.when(F.length(found) > 0, found)


def json_array(text: Column) -> Column:
    """The outermost [...] of a text; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(F.length(found) > 0, found)


def products_of(text: Column) -> Column:
    """Product structs of an answer with defaults; use inline() on it."""
    parsed = F.from_json(json_array(text), "array<struct<brand:string,type:string,approx_count:int,confidence:double,keywords:array<string>>>")
    return F.transform(
        F.filter(parsed, lambda p: p.isNotNull()),
        lambda p: F.struct(
            F.coalesce(p["brand"], F.lit("unknown")).alias("brand"), F.coalesce(p["type"], F.lit("unknown")).alias("type"), F.coalesce(p["approx_count"], F.lit(1)).alias("approx_count"),
            F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(p["keywords"], F.array().cast("array<string>")).alias("keywords"),
        ),
    )


def origin_answer(text: Column) -> Column:
    """origin, confidence, reason of "origin|confidence|reason", or of the first origin word, or unknown."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\|")
    origin = F.lower(F.trim(F.try_element_at(parts, F.lit(1))))
    confidence = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    lower = F.lower(F.coalesce(text, F.lit("")))
    word = F.regexp_extract(lower, "(local|international)", 1)
    number = F.regexp_extract(lower, r"(0?\.\d+|1\.0)", 1).try_cast("double")
    valid = origin.isin("local", "international", "unknown")
    return F.struct(
        F.when(valid, origin).when(F.length(word) > 0, word).otherwise("unknown").alias("origin"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(valid & confidence.isNotNull(), confidence).when(number.isNotNull(), number).when(valid | (F.length(word) > 0), 0.5).otherwise(0.0))).alias("confidence"),
        F.coalesce(F.trim(F.try_element_at(parts, F.lit(3))), F.lit("")).alias("reason"),
    )


def get(map_column: Column, key: str, default: object) -> Column:
    return F.coalesce(F.try_element_at(map_column, F.lit(key)), F.lit(default))
