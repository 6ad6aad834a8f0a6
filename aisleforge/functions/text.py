"""Text functions for Latin and Thai shelf text, as column expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
#: Characters and combining marks of the Thai block.
THAI_RUN = r"[\x{0E00}-\x{0E7F}]+"

# fixed values: Thai digits, size units with the words that name them (longest first where one holds another)
THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
UNITS = {
    "ml": ("ml", "มล", "มิลลิลิตร"),
    "kg": ("kilograms", "kilogram", "kg", "กิโลกรัม"),
    "g": ("grams", "gram", "g", "กรัม"),
    "lb": ("pounds", "pound", "lb", "ปอนด์"),
    "l": ("l", "ลิตร"),
    "oz": ("oz", "ออนซ์"),
    "pack": ("pack", "แพ็ค"),
    "pcs": ("pieces", "piece", "pcs", "pc"),
}
NUMBER = r"\d+(?:[.,]\d+)?"
PRICE = r"(?:฿|บาท|baht|thb|\$)\s*\d+|\d+(?:[.,]\d+)?\s*(?:฿|บาท|baht|thb|\$)"
PROMOTION_WORDS = ("sale", "offer", "discount", "promo", "special", "ลด", "พิเศษ", "โปรโมชั่น", "เซล")
CURRENCIES, CURRENCIES_AFTER = "฿$€£¥", "฿$€£¥บาท"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Texts that are made strings at a time.
TEXTS = 64


def _normalized(text: pa.Array, form: str, strip: bool = False) -> pa.Array:
    """Texts in a normal form, few at a time, so that a worker holds a batch as bytes and not as strings; null becomes empty."""

    def made(value: str | None) -> str:
        value = value or ""
        found = value if value.isascii() else unicodedata.normalize(form, value)
        return found.strip() if strip else found

    parts = [pa.array([made(t) for t in text.slice(at, TEXTS).to_pylist()], pa.string()) for at in range(0, len(text), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition, trimmed; null becomes empty. Spark has no function for it."""
    return _normalized(text, "NFC", True)


@F.arrow_udf(T.StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Compatibility decomposition; null becomes empty."""
    return _normalized(text, "NFKD")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity ratio of two strings, 0 if one is null; use it on distinct pairs."""
    known: dict[tuple[str, str], float] = {}

    def ratio(x: str, y: str) -> float:
        if x is None or y is None:
            return 0.0
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def thai_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, DIGITS)


def clean(c: Column) -> Column:
    """Arabic digits, single spaces, trimmed (compose with nfc where input may be decomposed)."""
    return F.trim(F.regexp_replace(thai_digits(or_empty(c)), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased words of more than one character."""
    return F.filter(F.regexp_extract_all(F.lower(clean(c)), F.lit(WORD), F.lit(0)), lambda t: F.length(t) > 1)


def unit_pattern(words: tuple[str, ...]) -> str:
    return "(?i)(" + NUMBER + r")\s?(?:" + "|".join(words) + r")(?![A-Za-z])"


def sizes(c: Column) -> Column:
    """Distinct "value unit" strings in the order of the units, then of the text."""
    text = clean(c)

    def named(unit: str, words: tuple[str, ...]) -> Column:
        values = F.regexp_extract_all(text, F.lit(unit_pattern(words)), F.lit(1))
        return F.transform(values, lambda v: F.concat(F.replace(v, F.lit(","), F.lit(".")), F.lit(" " + unit)))

    return F.array_distinct(F.concat(*[named(unit, words) for unit, words in UNITS.items()]))


def normalized_size(first: Column) -> Column:
    """A "value unit" string in ml or g, whole numbers without decimals, others with one."""
    value = F.split_part(first, F.lit(" "), F.lit(1)).try_cast("double")
    unit = F.split_part(first, F.lit(" "), F.lit(2))
    scaled = F.when(unit.isin("l", "kg"), value * 1000).otherwise(value)
    name = F.when(unit == "l", "ml").when(unit == "kg", "g").otherwise(unit)
    number = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(F.format_string("%.1f", scaled))
    return F.when(value.isNull(), first).otherwise(F.concat(number, name))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets; `both_empty` for two empty ones, 0 if one is empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def brand_candidates(c: Column) -> Column:
    """Words of two or more characters that are not all digits and hold a capital."""
    return F.filter(F.split(clean(c), " "), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & w.rlike(r"\p{Lu}"))


def dehyphenate(c: Column) -> Column:
    """Joins words broken by a hyphen, also a soft one, at a line end."""
    return F.regexp_replace(F.regexp_replace(or_empty(c), r"-\s*\n\s*", ""), r"[\x{00AD}\x{2010}\x{2011}]\s*\n\s*", "")


def any_word(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(words)


def text_type(c: Column) -> Column:
    """price, size, promotion, category (up to three words, one with a capital) or product: the first that fits; unknown without text."""
    text = clean(c)
    price = rf"[{CURRENCIES}]\s*\d|\d\s*[{CURRENCIES_AFTER}]"
    sized = "(?i)" + NUMBER + r"\s?(?:" + "|".join(w for ws in UNITS.values() for w in ws) + r")(?![A-Za-z])"
    heading = (F.size(F.split(text, " ")) <= 3) & text.rlike(r"\p{Lu}")
    return F.when(or_empty(c) == "", "unknown").when(text.rlike(price), "price").when(text.rlike(sized), "size").when(text.rlike(any_word(PROMOTION_WORDS)), "promotion").when(heading, "category").otherwise("product")


def crop_text_type(c: Column) -> Column:
    """price, thai_name, size, brand or general: the first that fits."""
    text = or_empty(c)
    return F.when(text.rlike("(?i)" + PRICE), "price").when(text.rlike(THAI_RUN), "thai_name").when(text.rlike("(?i)" + NUMBER + r"\s?(?:ml|l|g|kg|oz)(?![A-Za-z])"), "size").when(text.rlike(r"^\p{Lu}[\p{L} ]*$"), "brand").otherwise("general")


def ocr_tokens(c: Column) -> Column:
    """Distinct lower-cased words left after prices, sizes and numbers are removed."""
    text = F.lower(or_empty(c))
    for pattern in (PRICE, NUMBER + r"\s?(?:ml|l|g|kg|oz)(?![a-z])", r"\d+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= 2))


def annotation_tokens(texts: Column, field: str = "name") -> Column:
    """Distinct lower-cased words of an array of annotations."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.lower(or_empty(t[field])), F.lit(WORD), F.lit(0)))))


def normalized_thai(c: Column) -> Column:
    """Lower-cased and trimmed, without the vowel sign U+0E31."""
    return F.trim(F.replace(F.lower(or_empty(c)), F.lit("ั"), F.lit("")))


def scripts(c: Column) -> Column:
    """thai and english: runs of either script longer than one character."""
    text = or_empty(c)
    longer = lambda xs: F.filter(xs, lambda x: F.length(x) > 1)
    return F.struct(longer(F.regexp_extract_all(text, F.lit(THAI_RUN), F.lit(0))).alias("thai"), longer(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("english"))


# fixed values: words without meaning for categories
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "was", "are", "not", "but", "all")


def preprocessed(c: Column) -> Column:
    """Lower-cased words of more than two characters without punctuation and stop words."""
    words = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def slug(c: Column) -> Column:
    """A category code of at most 20 characters."""
    return F.substring(F.replace(F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_")), F.lit("products"), F.lit("")), 1, 20)


def shortened(c: Column, most: int = 15) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def file_name(c: Column) -> Column:
    """A name safe for files."""
    return F.regexp_replace(c, r"[^\w\-.]", "_")


def sku_id(*parts: Column) -> Column:
    """Twelve hex characters of the MD5 of the lower-cased parts joined by bars; null counts as empty."""
    return F.substring(F.md5(F.lower(F.concat_ws("|", *[or_empty(p) for p in parts]))), 1, 12)


def stamp(c: Column) -> Column:
    """A time as reports show it."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def file_stamp(c: Column) -> Column:
    """A time as file names carry it, which sorts as it does."""
    return F.date_format(c, "yyyyMMdd_HHmmss")
