"""Text, score and parsing functions on tables of cases."""

import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aisleforge import model
from aisleforge.config import Config
from aisleforge.functions import parsing, scores, text


def values(spark, function, cases):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    return [r[0] for r in df.orderBy("k").select(function(F.col("c")).alias("v")).collect()]


def test_text_functions(spark):
    cases = {
        text.thai_digits: [("๑๒x๙", "12x9"), (None, None)],
        text.clean: [("  a \n\t b  ", "a b"), (None, ""), ("๕ ml", "5 ml")],
        text.tokens: [("Milk, 2% Fat-free x", ["milk", "fat", "free"]), ("น้ำ ปลา", ["ปลา"]), (None, [])],
        text.sizes: [("Water 1,5 l and 500 ML pack", ["500 ml", "1.5 l"]), ("2 kg / 2kg", ["2 kg"]), ("6 pack 3 pcs", ["6 pack", "3 pcs"]), ("12 lb 4 oz", ["12 lb", "4 oz"]), ("5 kilograms", ["5 kg"]), (None, []), ("no size", [])],
        text.normalized_size: [("1.5 l", "1500ml"), ("2 kg", "2000g"), ("0.25 oz", "0.3oz"), ("330 ml", "330ml")],
        text.dehyphenate: [("choco-\n late", "chocolate"), ("a­\nb", "ab"), ("a-b", "a-b"), (None, "")],
        text.brand_candidates: [("Nova 123 tea X Öko", ["Nova", "Öko"]), (None, [])],
        text.text_type: [("฿ 25", "price"), ("25 บาท", "price"), ("250 g", "size"), ("big SALE", "promotion"), ("ราคาพิเศษ", "promotion"), ("Noodles", "category"), ("aisle 4", "product"), ("Some of the noodles", "product"), ("", "unknown")],
        text.crop_text_type: [("25 baht", "price"), ("ข้าว", "thai_name"), ("50g", "size"), ("Nova Tea", "brand"), ("nova 7", "general")],
        text.ocr_tokens: [("Soap 50 ml $ 30 soap 7 a", ["soap"]), (None, [])],
        text.normalized_thai: [(" กัน ", "กน"), (None, "")],
        text.preprocessed: [("The BEST of tea, and of milk", ["best", "tea", "milk"])],
        text.slug: [("Food & Drink Products", "food_drink_")],
        text.shortened: [("abcdefghijklmnopq", "abcdefghijkl..."), ("short", "short")],
        text.file_name: [("a b/c:d.png", "a_b_c_d.png")],
        text.nfc: [("é ", "é"), (None, "")],
        text.nfkd: [("ﬁ", "fi")],
    }
    for function, pairs in cases.items():
        assert values(spark, function, [a for a, _ in pairs]) == [b for _, b in pairs], function.__name__


def test_scripts_and_sku(spark):
    found = values(spark, text.scripts, ["น้ำปลา fish S 20", None])
    assert found[0].english == ["fish"] and len(found[0].thai) == 1 and found[1].thai == []
    df = spark.createDataFrame([("Nova", None), ("nova", "")], "a string, b string")
    ids = {r[0] for r in df.select(text.sku_id(F.col("a"), F.col("b"))).collect()}
    assert len(ids) == 1 and len(ids.pop()) == 12


def test_jaccard_rules_for_empty_sets(spark):
    df = spark.sql("SELECT array() AS e, array('a', 'b') AS x, array('b', 'c') AS y").select(*[F.col(c).cast("array<string>").alias(c) for c in "exy"])
    e, x, y = F.col("e"), F.col("x"), F.col("y")
    assert df.select(text.jaccard(e, e), text.jaccard(e, e, 0.0), text.jaccard(e, x), text.jaccard(x, y), text.jaccard(y, x)).first() == (1.0, 0.0, 0.0, 1 / 3, 1 / 3)


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", None)]
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.sequence_ratio("a", "b")).collect()]
    assert found == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, 0.0]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scores(spark):
    lit = F.lit
    assert one(spark, scores.overall_confidence(lit(0.9), lit(0.8), lit(0.7)))[0] == 0.745
    assert one(spark, scores.overall_confidence(lit(1.0), lit(1.0), lit(1.0)))[0] == 0.9
    fused = one(spark, scores.fused_confidence(lit(0.9), lit(True), lit(9), lit(False)), scores.fused_confidence(lit(0.1), lit(False), lit(0), lit(True)))
    assert fused == (1.0, 0.0)
    assert one(spark, scores.hamming(lit("ff00"), lit("f0f0")), scores.hamming(lit("ab"), lit("abc"))) == (2, 3)
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scores.cosine(v(1.0, 0.0), v(1.0, 1.0)))[0] == pytest.approx(math.sqrt(0.5))
    assert one(spark, scores.cosine(v(1.0), v(-1.0)), scores.cosine(v(0.0), v(1.0))) == (0.0, 0.0)
    vector = one(spark, scores.hash_embedding(lit("tea")))[0]
    assert len(vector) == 128 and sum(x * x for x in vector) == pytest.approx(1) and vector[48:] == [0.0] * 80
    assert one(spark, scores.product_similarity(lit(1.0), lit(1.0), lit(True), lit(False), lit(0.9), lit(0.9)))[0] == pytest.approx(0.9)
    assert one(spark, scores.duration(lit(3725.0)), scores.duration(lit(64)), scores.duration(lit(5))) == ("1h 02m", "1m 04s", "5s")
    assert one(spark, scores.image_quality(lit(500.0), lit(64.0)), scores.image_quality(lit(9000.0), lit(64.0))) == (0.5, 1.0)


def test_zones_and_tiers(spark):
    ys = [0.0, 0.25, 0.2500001, 0.65, 0.66, 0.75, 0.76, 1.0, None]
    df = spark.createDataFrame([(k, y) for k, y in enumerate(ys)], "k int, y double").orderBy("k")
    rows = df.select(scores.zone(F.col("y")).alias("z"), scores.shelf_tier(F.col("y"), F.lit(True)).alias("t"), scores.shelf_tier(F.col("y"), F.lit(False)).alias("f")).collect()
    assert [r.z for r in rows] == ["top", "top", "eye", "eye", "middle", "middle", "bottom", "bottom", None]
    assert [r.t for r in rows] == [4, 3, 3, 2, 2, 1, 1, 1, 0]
    assert [r.f for r in rows] == [3, 3, 3, 2, 2, 1, 1, 1, 0]


def test_geometry(spark):
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 10), (20, 10), (20, 30), (0, 30))])
    assert one(spark, scores.box_centre(corners, F.lit(100)))[0] == 0.2
    assert tuple(one(spark, scores.box_bounds(corners))[0]) == (0, 10, 20, 30)
    assert len(one(spark, scores.grid_crops(F.lit(800), F.lit(600)))[0]) == 64
    assert len(one(spark, scores.scale_crops(F.lit(800), F.lit(600)))[0]) == 13
    small, large = one(spark, scores.padded_box(F.lit(0), F.lit(0), F.lit(10), F.lit(10), F.lit(20), F.lit(20)), scores.padded_box(F.lit(60), F.lit(60), F.lit(100), F.lit(90), F.lit(400), F.lit(400)))
    assert small is None and tuple(large) == (10, 10, 140, 130)


def test_parsing(spark):
    answers = ['```json\n{"a": {"b": 1}}\n```', 'text {"a": 1} tail', "nothing", None]
    assert values(spark, parsing.json_object, answers) == ['{"a": {"b": 1}}', '{"a": 1}', None, None]
    found = values(spark, parsing.products_of, ['x [{"brand": "N", "confidence": 0.9}, {"type": "tea"}] y', "[oops"])
    assert [(p.brand, p.type, p.approx_count, p.confidence, p.keywords) for p in found[0]] == [("N", "unknown", 1, 0.9, []), ("unknown", "tea", 1, 0.5, [])]
    assert not found[1]
    origins = values(spark, parsing.origin_answer, ["local|0.8|because", "It is International, 0.7", "LOCAL", "no idea", None, "unknown|x|"])
    assert [(o.origin, o.confidence) for o in origins] == [("local", 0.8), ("international", 0.7), ("local", 0.5), ("unknown", 0.0), ("unknown", 0.0), ("unknown", 0.5)]


@given(st.lists(st.floats(0, 1), min_size=3, max_size=3))
@settings(max_examples=5, deadline=None)
def test_confidence_stays_in_bounds(parts):
    from pyspark.sql import SparkSession

    value = SparkSession.getActiveSession().range(1).select(scores.overall_confidence(*map(F.lit, parts))).first()[0]
    assert 0 <= value <= 0.9


def test_config(spark):
    assert Config.of(spark, category_min=0.2).category_min == 0.2
    spark.conf.set("aisleforge.logo_min", "0.5")
    assert Config.of(spark).logo_min == 0.5
    spark.conf.unset("aisleforge.logo_min")
    with pytest.raises(ValueError):
        Config.of(weight_logo=0.9)
    with pytest.raises(ValueError):
        Config.of(ssim_min=1.5)


def test_model(spark):
    assert all(len(model.schema(name)) > 5 for name in model.SCHEMAS)
    df = spark.createDataFrame([("a", None)], "type string, store string")
    named = model.canonical(df)
    assert named.columns == ["product_type", "supermarket"]
    assert model.with_defaults(named, ["supermarket", "brand"]).first().asDict() == {"product_type": "a", "supermarket": "Unknown", "brand": "Unknown"}
    assert model.resolve_column(df, ["ore"], contains=True) == "store" and model.resolve_column(df, ["x"]) is None
    rows = spark.createDataFrame([(0.5, "yes", [1.0]), (1.5, "maybe", [1.0, 2.0]), (None, None, None)], "c double, p string, b array<double>")
    good, bad = model.quarantine(rows, model.problems(rows, {"c": (0, 1)}, {"p": model.ALLOWED["private_label"]}, {"b": 1}))
    assert good.count() == 2 and bad.first().problems == ["c", "p", "b"]
