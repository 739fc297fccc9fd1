"""Text functions on samples with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X

VOCABULARY = {"laptop": ("laptop", "computer"), "wifi": ("wifi", "wi-fi"), "software": ("app",)}


def one(spark, expression, value):
    frame = spark.createDataFrame([(value,)], "t string")
    return frame.select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function,value,expected",
    [
        (X.clean_helpdesk, " one \t two\n\nthree", "one two three"),
        (X.clean_helpdesk, None, ""),
        (X.clean_helpdesk, "0", "0"),
        (X.clean_helpdesk, " Where Can WE Park Bicycles?! ", "where can we park bicycles"),
        (X.tokenize, "where is the lunch menu", ["where", "is", "the", "lunch", "menu"]),
        (X.tokenize, "habit's don't", ["habit", "is", "do", "not"]),
        (X.tokenize, None, []),
        (lambda c: X.remove_stopwords(X.tokenize(c)), "where is the lunch menu", ["lunch", "menu"]),
        (lambda c: X.extract_entities(c, VOCABULARY), "No wi-fi on this computer!", ["laptop", "wifi"]),
        (lambda c: X.extract_entities(c, VOCABULARY), "apply", []),
        (X.release_year, "Northern Lights (1987)", 1987),
        (X.release_year, "Northern Lights (soon)", None),
        (X.strip_release_year, "Northern Lights (1987) ", "Northern Lights"),
        (X.normal_tokens, "Well-known  crêpes?", ["well-known", "crêpes"]),
        (X.split_values, "Sea|Sky", ["Sea", "Sky"]),
        (X.split_values, " ", ["(none)"]),
        (X.normalize_intent, " LAPTOP issue ", "laptop_problems"),
        (X.normalize_entity, "password_reset", "password"),
        (X.normalize_entity, "unknown thing", "unknown_thing"),
        (X.clean_news_train, "<b>Ferry LATE again.</b> See https://harbour.test/x now\nor write desk@harbour.test 2024 #fog!", "ferry late again see now or write fog"),
        (X.clean_news_serve, "Ferry http://harbour.test is it LATE?? a@b.c", "ferry late"),
        (X.typographic, " it’s “so”–so ", "it's \"so\"-so"),
        (lambda c: X.ngrams(X.normal_tokens(c), 2), "a b c", ["a b", "b c"]),
        (lambda c: X.ngrams(X.normal_tokens(c), 3), "a b", []),
        (X.is_blank, " \t\n", True),
        (X.strip, " x ", "x"),
        (lambda c: F.year(X.parse_date(c)), "March 4, 2011", 2011),
        (lambda c: F.year(X.parse_date(c)), "07-Oct-99", 1999),
        (lambda c: X.parse_date(c), "no date", None),
    ],
)
def test_functions(spark, function, value, expected):
    assert one(spark, function, value) == expected


@pytest.mark.parametrize(
    "word,expected",
    [("cats", "cat"), ("cities", "city"), ("boxes", "box"), ("churches", "church"), ("glasses", "glass"), ("glass", "glass"), ("bus", "bus"), ("analysis", "analysis"),
     ("is", "is"), ("ideas", "idea"), ("taxis", "taxis"), ("ran", "ran"), ("", ""), ("as", "as"), (None, None)],
)
def test_lemma(spark, word, expected):
    assert one(spark, X.lemma, word) == expected
