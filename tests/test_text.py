"""Text and weight expressions on hand-checked values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import text, weights


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean(spark):
    raw = ["﻿ a  b ", '"quoted"', None, "x​y", ' " in " ']
    assert evaluate(spark, raw, text.clean) == ["a b", "quoted", "", "xy", "in"]


def test_normalize(spark):
    raw = ["Ёлка №5", "1,2,3", "10х20x30", "16Гб", "«А» — Б", "5%", "2,5мг/мл"]
    assert evaluate(spark, raw, text.normalize) == [
        "елка n 5", "1.2.3", "10 x 20 x 30", "16 гб", '"а" - б', "5%", "2.5 мг/мл",
    ]


def test_tokens_keep_order_and_split_compounds(spark):
    out = evaluate(spark, ["Флеш-накопитель USB 2.0 и USB для ПК"], text.tokenize)[0]
    assert out == ["флеш-накопитель", "флеш", "накопитель", "usb", "2.0", "2", "0", "пк"]


def test_stem_and_lemma(spark):
    words = ["конфеты", "конфетами", "рабочая", "рабочие", "дом", "usb", "флеш-карты", "x1"]
    assert evaluate(spark, words, text.stem) == [
        "конфет", "конфет", "рабоч", "рабоч", "дом", "usb", "флеш-карт", "x1",
    ]
    kept = evaluate(spark, ["конфеты", "флеш-карты"], lambda c: text.lemma(c, F.lit("token")))
    assert kept == ["конфет", "флеш-карты"]
    assert evaluate(spark, ["конфеты"], lambda c: text.lemma(c, F.lit("brand"))) == ["конфеты"]


def test_layout(spark):
    assert evaluate(spark, ["aktirf", "ыьфдд", "16", "мix"], text.layout_variant) == [
        "флешка", "small", None, None,
    ]


def test_numbers_and_types(spark):
    out = evaluate(spark, ["16 гб", "usb 2.0", "нет"], text.number_and_unit)
    assert [(r.value, r.unit) for r in out] == [(16.0, "гб"), (2.0, None), (None, None)]
    kinds = evaluate(spark, ["гб", "x1", "smartbuy", "500", "товар"], text.infer_term_type)
    assert kinds == ["unit", "model", "brand", "model", "token"]


def test_attributes(spark):
    raw = ["Цвет:черный;Объем: 16 ГБ|пусто;A:b:c;:x;y:"]
    out = evaluate(spark, raw, text.parse_attributes)[0]
    assert [(a.pos, a.name_raw, a.value_norm, a.numeric_value) for a in out] == [
        (1, "Цвет", "черный", None), (2, "Объем", "16 гб", 16.0), (3, "A", "b:c", None),
    ]
    assert evaluate(spark, ["a:1;b:2;a:3"], text.attribute_map) == [{"b": "2", "a": "3"}]
    twice = evaluate(
        spark, ["Цвет:Черный;цвет:черный;Цвет:белый"],
        lambda c: text.dedupe_attributes(text.parse_attributes(c)),
    )[0]
    assert [a.value_raw for a in twice] == ["Черный", "белый"]


def test_brand_and_model(spark):
    titles = ["Ноутбук Lenovo ThinkPad X1", "Флешка 16"]
    brands = evaluate(spark, titles, lambda c: text.guess_brand(text.tokenize(c)))
    models = evaluate(spark, titles, lambda c: text.guess_model(text.tokenize(c)))
    assert brands == ["Lenovo", "Usb"] and models == ["X1", None]


def test_weights(spark):
    rows = spark.createDataFrame(
        [(datetime(2025, 5, 31), 100.0), (datetime(2026, 1, 1), -1.0), (None, None),
         (datetime(2000, 1, 1), 1e9)],
        "at timestamp, cost double",
    )
    as_of = F.lit(datetime(2025, 6, 1))
    out = rows.select(
        weights.recency_weight(F.col("at"), as_of).alias("r"), weights.cost_weight(F.col("cost")).alias("c")
    ).collect()
    assert [r.r for r in out] == pytest.approx([1.5 - 1 / 3650, 0, 0, 0.5])
    assert [r.c for r in out] == pytest.approx([0.3402321, 0, 0, 0.6])


def test_exploration_is_stable(spark):
    bonus = spark.range(1).select(
        weights.exploration_bonus(F.lit("7"), F.lit("c"), F.lit("1"), F.lit(False)).alias("b"),
        weights.exploration_bonus(F.lit(None).cast("string"), F.lit("c"), F.lit("1"), F.lit(True)).alias("g"),
    ).first()
    import hashlib

    def expected(seed, ceiling):
        return round(int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF * ceiling, 4)

    assert bonus.b == expected("7::c::1", 0.18) and bonus.g == expected("global::c::1", 0.04)
