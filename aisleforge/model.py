"""Schemas of the pipeline's records, and helpers that bring a DataFrame into one of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names, types and order of the records' fields are the interface that files in use have
#: Schemas by name, as DDL; a session is needed only when one is asked for.
SCHEMAS = {
    "crop_context": (
        "image_id string, crop_id string, bbox array<double>, type string, ocr_raw string, ocr_tokens array<string>, "
        "logo_candidates array<struct<brand:string,score:double>>, scores map<string,double>"
    ),
    "consolidated": (
        "image_id string, crop_id string, brand_th string, brand_en string, product_th string, product_en string, variant_th string, variant_en string, "
        "size_raw string, size_normalized string, category_th string, category_en string, subcategory_th string, subcategory_en string, signage_type string, "
        "private_label string, facings_hint int, placement string, conf_logo double, conf_ocr double, conf_detector double, conf_overall double, review_needed boolean, notes string"
    ),
    "image_metadata": (
        "image_id string, file_path string, file_name string, file_size bigint, dimensions struct<width:int,height:int>, quality_score double, sharpness double, "
        "brightness_mean double, phash string, crop_count int, duplicate_group_id string, is_duplicate boolean, canonical_image_id string"
    ),
    "product": (
        "brand string, origin string, confidence double, classification_method string, matched_patterns string, product_type string, category string, image_id string, "
        "duplicate_count bigint, source_images string, supermarket string"
    ),
    "detection": (
        "image_id string, brand string, type string, approx_count int, conf_fused double, source_data struct<vision:struct<brand:string,type:string,approx_count:int,"
        "confidence:double,keywords:array<string>>,ocr_tokens:array<string>,logos:array<struct<brand:string,conf:double>>>"
    ),
    "eye_level": (
        "image_id string, brand string, type string, eye_level_zone string, y_position double, is_premium_zone boolean, shelf_tier int, brand_origin string, category string, duplicate_count bigint"
    ),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


# fixed values: allowed values of the enumerations, and names a column may go by
ALLOWED = {
    "signage_type": ("CategoryHeader", "Promo", "Claim", "Price", "None"),
    "private_label": ("yes", "no", "unknown"),
    "placement": ("EyeLevel", "Endcap", "Checkout", "None"),
}
ALIASES = {"product_type": ("product_type", "type"), "origin": ("origin", "brand_origin"), "supermarket": ("supermarket", "store")}


def resolve_column(df: DataFrame, names: Iterable[str], contains: bool = False) -> str | None:
    """The first of the names that is a column, or with `contains` the first column that has one of them in its name."""
    for name in names:
        for column in df.columns:
            if column == name or contains and name.lower() in column.lower():
                return column
    return None


def canonical(df: DataFrame) -> DataFrame:
    """Renames columns that go by another of their names."""
    for name, others in ALIASES.items():
        held = resolve_column(df, others)
        if held and held != name:
            df = df.withColumnRenamed(held, name)
    return df


def with_defaults(df: DataFrame, columns: Iterable[str], default: str = "Unknown") -> DataFrame:
    """Adds the columns that are missing and fills nulls of all of them."""
    columns = list(columns)
    added = {c: F.lit(default) for c in columns if c not in df.columns}
    return df.withColumns(added).fillna(default, subset=columns)


def problems(df: DataFrame, ranges: dict[str, tuple[float, float | None]], enums: dict[str, tuple[str, ...]], lengths: dict[str, int] | None = None) -> Column:
    """An array with the names of the columns whose value is outside its domain; nulls are inside."""
    checks: list[Column] = []
    for name, (low, high) in ranges.items():
        bad = F.col(name) < low
        checks.append(F.when(bad if high is None else bad | (F.col(name) > high), name))
    for name, allowed in enums.items():
        checks.append(F.when(~F.col(name).isin(*allowed), name))
    for name, size in (lengths or {}).items():
        checks.append(F.when(F.size(name) != size, name))
    return F.array_compact(F.array(*checks))


def quarantine(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Rows inside every domain, and the others with their `problems`."""
    marked = df.withColumn("problems", found)
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)
