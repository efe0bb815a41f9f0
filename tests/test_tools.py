import json
import math

import pytest
from pyspark.sql import functions as F

from lectern.functions.numbers import divide, factorial, logarithm, modulo, round_score
from lectern.functions.text import preview, source_name
from lectern.operators.formulas import formula_columns
from lectern.operators.lookup import LOOKUP_SCHEMA, keyword_lookup, prefer, with_fallback
from lectern.operators.responses import envelope, normalise_responses
from lectern.operators.units import convert_units, conversion_table, requested_units, supported_units


def evaluate(spark, **formulas):
    return formula_columns(spark.range(1), formulas).first()


@pytest.mark.parametrize(
    "formula, expected",
    [
        (lambda: F.lit(45) * 32 + 17, 1457),
        (lambda: F.lit(127) * 53 + 89, 6820),
        (lambda: divide(F.lit(100), F.lit(4)), 25),
        (lambda: F.power(F.lit(2), F.lit(10)), 1024),
        (lambda: F.sqrt(F.lit(144)), 12),
        (lambda: logarithm(F.lit(100), 10), 2),
        (lambda: factorial(F.lit(10)), 3628800),
        (lambda: factorial(F.lit(170)), float(math.factorial(170))),
        (lambda: modulo(F.lit(1e20), F.lit(7.0)), float(10**20 % 7)),
        (lambda: modulo(F.lit(-7.0), F.lit(3.0)), 2.0),
        (lambda: modulo(F.lit(7.0), F.lit(-3.0)), -2),
        (lambda: modulo(F.lit(-7.0), F.lit(3.0)), 2),
    ],
)
def test_formulas_with_whole_results(spark, formula, expected):
    got = evaluate(spark, f=formula())
    assert (got["f"], got["f_integral"], got["f_status"]) == (expected, True, "success")


def test_formulas_with_fractions(spark):
    got = evaluate(spark, sine=F.sin(F.pi() / 2), third=divide(F.lit(1.0), F.lit(3.0)), e=F.exp(F.lit(1)))
    assert got["sine"] == pytest.approx(1.0, abs=1e-6)
    assert got["third"] == pytest.approx(1 / 3) and not got["third_integral"]
    assert got["e"] == pytest.approx(math.e)


@pytest.mark.parametrize(
    "formula",
    [
        lambda: divide(F.lit(1), F.lit(0)),
        lambda: modulo(F.lit(1.0), F.lit(0.0)),
        lambda: F.sqrt(F.lit(-1)),
        lambda: F.ln(F.lit(-1)),
        lambda: F.exp(F.lit(1000)),
        lambda: -F.exp(F.lit(1000)),
        lambda: factorial(F.lit(171)),
        lambda: factorial(F.lit(2.5)),
        lambda: F.lit(None).cast("double"),
    ],
)
def test_formulas_without_a_number_are_errors(spark, formula):
    got = evaluate(spark, f=formula())
    assert (got["f"], got["f_integral"], got["f_status"]) == (None, False, "error")


def convert(spark, *rows):
    df = spark.createDataFrame(rows, "value double, from_unit string, to_unit string")
    return convert_units(df).collect()


@pytest.mark.parametrize(
    "value, source, target, expected",
    [
        (100.0, "celsius", "fahrenheit", 212.0),
        (32.0, "fahrenheit", "celsius", 0.0),
        (10.0, "km", "miles", 6.2137),
        (1.0, "kg", "lbs", 2.2046),
        (100.0, "Celsius", "Fahrenheit", 212.0),
        (98.6, "fahrenheit", "celsius", 37.0),
        (1.0, "miles", "km", 1.6093),
        (1.0, "lbs", "kg", 0.4536),
        (1.0, "meters", "feet", 3.2808),
        (1.0, "feet", "meters", 0.3048),
    ],
)
def test_conversions(spark, value, source, target, expected):
    (got,) = convert(spark, (value, source, target))
    assert (got["result"], got["status"], got["error"]) == (expected, "success", None)
    assert (got["from_unit"], got["supported_units"]) == (source, None)


@pytest.mark.parametrize("pair", [("gallons", "liters"), ("km", "km"), ("km ", "miles"), (None, "km")])
def test_unknown_pairs(spark, pair):
    (got,) = convert(spark, (1.0, *pair))
    assert got["status"] == "error" and got["result"] is None
    assert got["supported_units"] == [
        "celsius", "fahrenheit", "feet", "kg", "km", "lbs", "meters", "miles",
    ]
    if pair[0] == "gallons":
        assert got["error"] == "Unsupported conversion: gallons -> liters"


def test_own_conversion_table(spark):
    table = spark.createDataFrame(
        [("dozen", "pieces", 0.0, 12.0, 1.0, 0.0)], conversion_table(spark).schema
    )
    df = spark.createDataFrame([(2.0, "Dozen", "pieces")], "value double, from_unit string, to_unit string")
    assert convert_units(df, table).first()["result"] == 24.0
    assert supported_units(table).first()[0] == ["dozen", "pieces"]
    asked = {tuple(r) for r in requested_units(df, table).collect()}
    assert asked == {("dozen", 1, True), ("pieces", 1, True)}


ENTRIES = [
    (1, "iris", "about iris", [("Iris data", "u1", "c1"), ("Iris again", "u2", "c2")]),
    (2, "nvidia", "about nvidia", [("Chips", "u3", "c3")]),
    (3, "iran", "about iran", []),
]


def look_up(spark, *queries, **options):
    table = spark.createDataFrame(ENTRIES, LOOKUP_SCHEMA)
    df = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    return {r["query"]: r for r in with_fallback(keyword_lookup(df, table, **options)).collect()}


@pytest.mark.parametrize("inline_keys", [64, 0])
def test_lookup(spark, inline_keys):
    both = "iran and the NVIDIA iris"
    got = look_up(
        spark, "What is the Iris dataset?", "Miranda rights", "quantum computing", both, inline_keys=inline_keys
    )
    assert got["What is the Iris dataset?"]["results"][0]["title"] == "Iris data"
    assert got["Miranda rights"]["answer"] == "about iran"
    assert got[both]["answer"] == "about iris"
    missing = got["quantum computing"]
    assert (missing["source"], missing["status"], len(missing["results"])) == ("generated", "success", 1)
    assert missing["results"][0]["url"] == "https://www.google.com/search?q=quantum+computing"
    assert "quantum computing" in missing["answer"] and got[both]["source"] == "stored"


@pytest.mark.parametrize("inline_keys", [64, 0])
def test_lookup_of_whole_words(spark, inline_keys):
    got = look_up(spark, "Miranda rights", "to Iran!", "the_iris", word=True, inline_keys=inline_keys)
    assert got["Miranda rights"]["source"] == "generated"
    assert got["to Iran!"]["answer"] == "about iran"
    assert got["the_iris"]["answer"] == "about iris"


def test_lookup_caps(spark):
    assert len(look_up(spark, "iris", max_results=1)["iris"]["results"]) == 1
    assert look_up(spark, "iris", max_results=0)["iris"]["results"] == []
    with pytest.raises(ValueError):
        look_up(spark, "iris", max_results=-1)


def test_lookup_without_entries(spark):
    empty = spark.createDataFrame([], LOOKUP_SCHEMA)
    df = spark.createDataFrame([(1, "q"), (2, None)], "query_id int, query string")
    assert [r["key"] for r in keyword_lookup(df, empty).collect()] == [None, None]


def test_responses(spark):
    raws = {
        1: {"answer": "a", "results": [{"title": "t", "url": "u", "content": "x" * 600}, {}, {"url": None}, {}]},
        2: {},
        3: {"results": []},
    }
    rows = [(n, json.dumps(raw)) for n, raw in raws.items()]
    rows += [(4, "not json"), (5, None), (6, '{"answer": "cut of'), (7, '["list"]')]
    df = spark.createDataFrame(rows, "query_id int, raw string")
    got = {r["query_id"]: r for r in normalise_responses(df).collect()}
    assert got[1]["answer"] == "a" and len(got[1]["results"]) == 3
    assert got[1]["results"][0]["content"] == "x" * 500
    assert tuple(got[1]["results"][1]) == ("", "", "") == tuple(got[1]["results"][2])
    assert (got[2]["answer"], got[2]["results"], got[2]["valid"]) == ("", [], True)
    assert (got[3]["answer"], got[3]["results"], got[3]["valid"]) == ("", [], True)
    for n in (4, 5, 6):
        assert (got[n]["answer"], got[n]["results"], got[n]["valid"]) == (None, None, False)
    assert not got[7]["answer"]


def test_prefer(spark):
    primary = spark.createDataFrame([(1, "p1", True), (2, "p2", False)], "query_id int, answer string, valid boolean")
    fallback = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "query_id int, answer string")
    assert {tuple(r) for r in prefer(primary, fallback).collect()} == {
        (1, "p1", "primary"),
        (2, "f2", "fallback_after_error"),
        (3, "f3", "fallback"),
    }


def test_envelope(spark):
    df = spark.createDataFrame([(1, "a", None)], "query_id int, answer string, error string")
    assert json.loads(envelope(df).first()["reply"]) == {"answer": "a"}


def test_small_functions(spark):
    got = spark.range(1).select(
        source_name(F.lit("/a/b/book.pdf")).alias("name"),
        source_name(F.lit("book.pdf")).alias("bare"),
        preview(F.lit("x" * 300)).alias("preview"),
        round_score(F.lit(0.00005)).alias("half"),
        round_score(F.lit(-0.12344)).alias("down"),
    ).first()
    assert (got["name"], got["bare"], len(got["preview"])) == ("book.pdf", "book.pdf", 200)
    assert (got["half"], got["down"]) == (0.0001, -0.1234)


def test_large_and_unfit_conversions(spark):
    rows = [(1e16,), (float("nan"),), (float("inf"),)]
    df = spark.createDataFrame(rows, "value double").selectExpr("value", "'km' AS from_unit", "'miles' AS to_unit")
    got = [(r["result"], r["status"]) for r in convert_units(df).collect()]
    assert got == [(1e16 * 0.621371, "success"), (None, "error"), (None, "error")]


@pytest.mark.parametrize("inline_keys", [64, 0])
def test_entries_of_equal_priority_give_one_row(spark, inline_keys):
    table = spark.createDataFrame(
        [(1, "red", "R", []), (1, "ring", "S", []), (2, "blue", "B", [])], LOOKUP_SCHEMA
    )
    queries = spark.createDataFrame([(1, "red ring"), (2, "a ring"), (3, "none")], "query_id int, query string")
    got = keyword_lookup(queries, table, inline_keys=inline_keys).collect()
    assert sorted((r["query_id"], r["key"], r["answer"]) for r in got if r["key"]) == [(1, "red", "R"), (2, "ring", "S")]
    assert len(got) == 3
