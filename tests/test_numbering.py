import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import numbering
from lectern.sources.pages import numbered_pages, read_pages, read_text_books


def numbers(df):
    return sorted((r["g"], r["a"], r["b"], r["n"]) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; order keys are gappy, two-part and shuffled."""
    rng = random.Random(5)
    rows = [("hot", rng.randrange(40), i) for i in range(3000)]
    rows += [(f"g{i % 20}", rng.randrange(1000), i) for i in range(600)]
    rng.shuffle(rows)
    return rows


def test_numbers_are_ranks(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, a int, b int").repartition(5)
    got = numbers(numbering.number_rows(df, "g", ["a", "b"], "n"))
    expected = []
    for group in {g for g, _, _ in skewed}:
        members = sorted(r for r in skewed if r[0] == group)
        expected += [(*row, place) for place, row in enumerate(members, 1)]
    assert got == sorted(expected)


def test_large_group_is_shared_out(spark, skewed):
    """The group of most rows lies in several ranges, and the rows are never gathered by group alone."""
    df = spark.createDataFrame(skewed, "g string, a int, b int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = numbering.place_rows(df, "g", ["a", "b"], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places.where("_group = 'hot'").select(F.max("n"), F.count_distinct("n")).first() == (3000, 3000)
    path = max((p for p in places.inputFiles()), key=len)
    stored = spark.read.parquet(path.rsplit("/", 1)[0])
    assert stored.where("_group = 'hot'").select(F.shiftright("_at", 33)).distinct().count() > 1
    plan = numbering.number_rows(df, "g", ["a", "b"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" not in plan.replace("coalesce(g#", "")


def test_ties_are_numbered_too(spark):
    df = spark.createDataFrame([("x", 1)] * 700 + [("x", 0)], "g string, a int").repartition(4)
    got = numbering.place_rows(df, "g", ["a"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 702))
    assert [r["_key0"] for r in got if r["n"] == 1] == [0]


def test_null_groups_and_null_order(spark):
    rows = [(None, i if i else None) for i in range(500)] + [("x", i if i else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int")
    got = numbering.number_rows(df, "g", ["a"], "n").collect()
    assert {(r["g"], r["a"] or 0, r["n"]) for r in got} == {(g, i, i + 1) for g in (None, "x") for i in range(500)}


def test_pages_count_from_one(spark):
    df = spark.createDataFrame([("b", 20, "two"), ("b", 10, "one"), ("a", 5, "only")], "book string, at int, t string")
    got = read_pages(df, "book", "at", "t")
    assert got.columns == ["source", "page_num", "content"]
    assert dict(got.dtypes)["page_num"] == "int"
    assert {tuple(r) for r in got.collect()} == {("b", 1, "one"), ("b", 2, "two"), ("a", 1, "only")}


def test_numbered_pages_is_a_projection(spark):
    df = spark.createDataFrame([("b", 7, "text")], "book string, page bigint, t string")
    got = numbered_pages(df, "book", "page", "t")
    assert got.first() == ("b", 7, "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_text_files_as_books(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\fsecond")
    (tmp_path / "two.txt").write_text("alone")
    got = read_text_books(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {
        ("one.txt", 1, "first"),
        ("one.txt", 2, "second"),
        ("two.txt", 1, "alone"),
    }
    assert got.where(F.col("content") == "").count() == 0
