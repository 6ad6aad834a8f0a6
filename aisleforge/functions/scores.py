"""Confidence, vector and position functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def overall_confidence(logo: Column, ocr: Column, detector: Column, config: Config = Config()) -> Column:
    """Weighted sum rounded half up to three places; the embedding component is not measured and counts as 0.

    Summed in decimals: in doubles a sum that ends in 5 would round by its error.
    """
    parts = [c.cast("decimal(10,6)") * F.lit(Decimal(str(w))) for c, w in ((logo, config.weight_logo), (ocr, config.weight_ocr), (detector, config.weight_detector))]
    return F.round(parts[0] + parts[1] + parts[2], 3).cast("double")


def needs_review(confidence: Column, config: Config = Config()) -> Column:
    return confidence < config.review_below


def fused_confidence(confidence: Column, brand_seen: Column, keyword_hits: Column, type_conflict: Column) -> Column:
    """+0.05 for a confirmed brand, +0.05 a keyword up to 0.15, -0.15 for a contradicting type; within 0..1."""
    return clamp(confidence + F.when(brand_seen, 0.05).otherwise(0.0) + F.least(keyword_hits * F.lit(0.05), F.lit(0.15)) - F.when(type_conflict, 0.15).otherwise(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings; of unequal lengths all of the longer."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(same)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, negative ones as 0; 0 for a null vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(0.0), dot(a, b) / size)).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def fused_embedding(image: Column, text: Column, share: float = 0.7) -> Column:
    return unit(F.zip_with(image, text, lambda x, y: x * share + y * (1 - share)))


def hash_embedding(text: Column, dims: int = 128) -> Column:
    """48 bytes of three salted MD5 sums, padded to `dims` and scaled to length 1."""

    digests = F.concat(*[F.md5(F.concat(text, F.lit(f"_{salt}"))) for salt in range(3)])
    # values bound by a lambda are computed once, so a long text is not hashed again for every element
    padded = F.transform(F.array(digests), lambda d: F.concat(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.conv(F.substr(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double")), F.array_repeat(F.lit(0.0), dims - 48)))
    return F.transform(padded, lambda v: unit(v))[0]


# fixed values: frequent words that say nothing of a product
COMMON = ("the", "and", "for", "new", "fresh")


def feature_text(brand: Column, kind: Column, category: Column | None, tokens: Column, most: int = 5) -> Column:
    """The text that a product's embedding is made of, in lower case: brand unless unknown, type, category name and the first telling tokens."""
    named = F.trim(F.coalesce(brand, F.lit("")))
    known = F.when((named != "") & (F.lower(named) != "unknown"), named)
    telling = F.slice(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*COMMON)), 1, most)
    return F.lower(F.concat_ws(" ", known, F.nullif(F.trim(kind), F.lit("")), *([] if category is None else [category]), telling))


def product_similarity(cos: Column, jac: Column, same_kind: Column, same_image: Column, conf_a: Column, conf_b: Column) -> Column:
    """(0.4 cosine + 0.3 Jaccard + 0.3 same brand and type - 0.2 same image) times the mean confidence, within 0..1."""
    mixed = cos * 0.4 + jac * 0.3 + F.when(same_kind, 0.3).otherwise(0.0) - F.when(same_image, 0.2).otherwise(0.0)
    return clamp(mixed * ((conf_a + conf_b) / 2))


def canonical_score(confidence: Column, n_tokens: Column, known_brand: Column, has_image: Column) -> Column:
    return confidence * 0.4 + F.least(n_tokens / F.lit(10.0), F.lit(1.0)) * 0.3 + F.when(known_brand, 0.2).otherwise(0.0) + F.when(has_image, 0.1).otherwise(0.0)


# fixed values: the effective shelf bands, upper ends inclusive, first match
ZONES = (("top", 0.25), ("eye", 0.65), ("middle", 0.75), ("bottom", 1.0))


def zone(y: Column) -> Column:
    """top, eye, middle or bottom of a relative height from 0 (top) to 1; null outside."""
    found = F.when(y.isNull() | (y < 0), F.lit(None).cast("string"))
    for name, upper in ZONES:
        found = found.when(y <= upper, name)
    return found


def premium(zone_name: Column) -> Column:
    return F.coalesce(zone_name.isin("eye", "middle"), F.lit(False))


def shelf_tier(y: Column, has_box: Column) -> Column:
    """4 (highest) to 1 with a box; without one 2 around the middle, 3 above, 1 below; 0 without a position."""
    boxed = F.when(y < 0.2, 4).when(y < 0.4, 3).when(y < 0.7, 2).otherwise(1)
    free = F.when((y >= 0.3) & (y <= 0.7), 2).when(y < 0.3, 3).otherwise(1)
    return F.when(y.isNull(), 0).when(has_box, boxed).otherwise(free)


def stable_position(brand: Column) -> Column:
    """A relative height that depends on the brand only."""
    return F.pmod(F.xxhash64(brand), F.lit(1000)) / F.lit(1000.0)


def image_quality(sharpness: Column, contrast: Column) -> Column:
    return F.least(F.lit(1.0), sharpness / 1000 * (contrast / 64))


def box_centre(vertices: Column, height: Column) -> Column:
    """Mean y of a polygon's corners relative to the image's height."""
    total = F.aggregate(F.transform(vertices, lambda v: v["y"].cast("double")), F.lit(0.0), lambda s, y: s + y)
    return total / F.size(vertices) / height


def box_bounds(vertices: Column) -> Column:
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def grid_crops(width: Column, height: Column, cells: int = 8, overlap: float = 0.3) -> Column:
    """An array of boxes on a grid whose neighbours overlap; explode it for one row per crop."""
    w, h = width / F.lit(float(cells)), height / F.lit(float(cells))
    steps = F.sequence(F.lit(0), F.lit(cells - 1))
    box = lambda r, c: F.struct(r.alias("row"), c.alias("col"), F.floor(c * w * (1 - overlap)).cast("int").alias("x"), F.floor(r * h * (1 - overlap)).cast("int").alias("y"), F.floor(w).cast("int").alias("width"), F.floor(h).cast("int").alias("height"))
    return F.flatten(F.transform(steps, lambda r: F.transform(steps, lambda c: box(r, c))))


def scale_crops(width: Column, height: Column) -> Column:
    """Four large quarters and nine medium ninths."""
    boxes = []
    for name, n in (("large", 2), ("medium", 3)):
        for r in range(n):
            for c in range(n):
                boxes.append(F.struct(F.lit(name).alias("scale"), F.floor(width * c / n).cast("int").alias("x"), F.floor(height * r / n).cast("int").alias("y"), F.floor(width / n).cast("int").alias("width"), F.floor(height / n).cast("int").alias("height")))
    return F.array(*boxes)


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: int = 50, least: int = 80) -> Column:
    """A text box with a margin, within the image; null if a side is under `least` pixels."""
    left, top = F.greatest(F.lit(0), x0 - pad), F.greatest(F.lit(0), y0 - pad)
    right, bottom = F.least(width, x1 + pad), F.least(height, y1 + pad)
    return F.when((right - left >= least) & (bottom - top >= least), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")))


def duration(seconds: Column) -> Column:
    """1h 02m, 3m 04s or 5s."""
    s = F.floor(seconds).cast("int")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60).cast("int"), s % 60)).otherwise(F.format_string("%ds", s))
