import pytest
from pyspark.sql import functions as F

from lectern.operators.routing import (
    TERM_SCHEMA,
    dispatch,
    parse_verdicts,
    route_learned,
    route_queries,
    train_router,
)
from lectern.operators.sessions import session_history, turn_pairs
from tests.conftest import plan_of

TERMS = [("forest", "RAG"), ("overfitting", "RAG"), ("convert", "GENERAL"), ("capital", "GENERAL")]


@pytest.mark.parametrize("inline_terms", [64, 0])
def test_routing(spark, inline_terms):
    queries = [
        (1, "Random FORESTS and overfitting"),
        (2, "Convert a forest"),
        (3, "The capital of Japan"),
        (4, "Meaning of life"),
        (5, "convert forest overfitting"),
    ]
    got = route_queries(
        spark.createDataFrame(queries, "query_id int, query string"),
        spark.createDataFrame(TERMS + TERMS[:1], TERM_SCHEMA),
        inline_terms=inline_terms,
    )
    rows = {r["query_id"]: (r["label"], r["confidence"], r["rag_hits"], r["general_hits"]) for r in got.collect()}
    assert rows == {
        1: ("RAG", "HIGH", 2, 0),
        2: ("GENERAL", "MEDIUM", 1, 1),
        3: ("GENERAL", "HIGH", 0, 1),
        4: ("GENERAL", "LOW", 0, 0),
        5: ("RAG", "MEDIUM", 2, 1),
    }


def test_short_term_lists_need_no_join(spark):
    got = route_queries(
        spark.createDataFrame([(1, "q")], "query_id int, query string"), spark.createDataFrame(TERMS, TERM_SCHEMA)
    )
    plan = plan_of(got)
    assert "Join" not in plan and "Exchange" not in plan


def test_learned_router(spark):
    rows = [("tree forest model", 1)] * 20 + [("weather price city", 0)] * 20
    model = train_router(spark.createDataFrame(rows, "query string, label int"))
    got = route_learned(spark.createDataFrame([("forest model",), ("city weather",)], "query string"), model)
    assert [(r["label"], r["confidence"]) for r in got.collect()] == [("RAG", "HIGH"), ("GENERAL", "HIGH")]


def test_verdicts(spark):
    texts = [
        "Classification: [RAG] -- Reason: about models\nConfidence: HIGH",
        "Classification: GENERAL -- Reason: arithmetic (LOW)",
        "nothing",
        None,
    ]
    got = parse_verdicts(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    assert [(r["label"], r["reason"], r["confidence"]) for r in got] == [
        ("RAG", "about models", "HIGH"),
        ("GENERAL", "arithmetic (LOW)", "LOW"),
        (None, None, None),
        (None, None, None),
    ]


def test_dispatch(spark):
    routed = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "query_id int, label string")
    got = dispatch(
        routed,
        {
            "A": lambda df: df.select("query_id", F.lit("a").alias("x")),
            "B": lambda df: df.select("query_id", F.lit("b").alias("y")),
        },
    )
    rows = {(r["query_id"], r["x"], r["y"], r["label"]) for r in got.collect()}
    assert rows == {(1, "a", None, "A"), (3, "a", None, "A"), (2, None, "b", "B")}


def test_dispatch_runs_the_routed_plan_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    labels = ["", "a/b=c", "label 2", "label 3", "é", "label 5"]
    routed = spark.createDataFrame([(i, labels[i % 6]) for i in range(60)], "query_id int, label string")
    got = dispatch(routed.mapInArrow(counted, routed.schema), {x: lambda df: df.select("query_id") for x in labels})
    assert {(r["query_id"], r["label"]) for r in got.collect()} == {(i, labels[i % 6]) for i in range(60)}
    assert runs.value == 60


@pytest.mark.parametrize("label", ["C", None])
def test_dispatch_refuses_labels_without_a_branch(spark, label):
    routed = spark.createDataFrame([(1, "A"), (2, label)], "query_id int, label string")
    with pytest.raises(Exception, match="no branch for label"):
        dispatch(routed, {"A": lambda df: df.select("query_id")}).collect()


TURNS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "q1"),
    (1, 2, "assistant", "r1"),
    (1, 3, "user", "q2"),
    (2, 0, "user", "q"),
    (2, 1, "user", "q again"),
    (2, 2, "assistant", "r"),
]


def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)


def test_history(spark):
    got = {r["conv_id"]: (r["n_turns"], r["history"]) for r in session_history(turns(spark), 2).collect()}
    assert got == {1: (2, "assistant: r1\nuser: q2"), 2: (2, "user: q again\nassistant: r")}
    assert plan_of(session_history(turns(spark), 2)).count("WindowGroupLimit") == 2
    with pytest.raises(ValueError):
        session_history(turns(spark), 0)


def test_pairs(spark):
    pairs = turn_pairs(turns(spark))
    got = {tuple(r) for r in pairs.select("conv_id", "turn", "question", "reply").collect()}
    assert got == {(1, 1, "q1", "r1"), (1, 3, "q2", None), (2, 0, "q", None), (2, 1, "q again", "r")}
    plan = plan_of(pairs)
    # One shuffle (the other is the fixture's own), one sort.
    assert plan.count("Exchange") == 2 and plan.count("Sort [") == 1


@pytest.mark.parametrize("rows_per_range", [1000, 2])
def test_pairs_over_gaps_other_roles_and_doubled_turns(spark, rows_per_range):
    rows = [
        (1, 10, "user", "q1"), (1, 15, "system", "note"), (1, 20, "assistant", "r1"),
        (2, 1, "user", "q"), (2, 1, "assistant", "r"), (2, 1, "assistant", "s"),
        (3, 1, "user", "a"), (3, 3, "user", "b"), (3, 9, "assistant", None),
        (4, 1, "assistant", "greeting"), (4, 2, "user", "c"),
        (None, 1, "user", "x"), (None, 2, "assistant", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    pairs = turn_pairs(df, rows_per_range=rows_per_range)
    assert {tuple(r) for r in pairs.select("conv_id", "turn", "question", "reply").collect()} == {
        (1, 10, "q1", "r1"), (2, 1, "q", "r"), (3, 1, "a", None), (3, 3, "b", None), (4, 2, "c", None), (None, 1, "x", "y"),
    }


def test_learned_router_without_words_or_labels(spark):
    queries = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (3, "?!")], "query_id int, query string")
    taught = spark.createDataFrame([("tree", 1), ("tree", None), (None, 1), ("", 0)], "query string, label int")
    got = route_learned(queries, train_router(taught))
    assert [r["label"] for r in got.collect()] == ["RAG"] * 4  # two of three labels
    nothing = train_router(taught.limit(0))
    assert {(r["label"], r["confidence"]) for r in route_learned(queries, nothing).collect()} == {("GENERAL", "LOW")}
    assert "Exchange" not in plan_of(got.select("query_id", "label")).split("Subquery")[0]
