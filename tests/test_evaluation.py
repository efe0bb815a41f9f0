import pytest
from pyspark.sql import functions as F

from lectern.operators.context import NO_CONTEXT, format_context
from lectern.operators.evaluation import (
    category_summary,
    confusion_table,
    distinct_categories,
    eval_cases,
    eval_outcomes,
    failed_cases,
    overall_summary,
    retrieved_context,
    route_accuracy,
)

OUTCOME = "id string, category string, status string, response_preview string, error string"


def test_built_in_cases(spark):
    cases = eval_cases(spark)
    rows = cases.collect()
    assert [r["id"] for r in rows] == [
        "rag_1", "rag_2", "rag_3", "rag_4", "tool_1", "tool_2", "tool_3", "direct_1", "edge_1", "edge_2",
    ]
    assert [r["expected_tool"] for r in rows][-3:] == [None, "calculator", None]
    assert [r["category"] for r in distinct_categories(cases).collect()] == [
        "calculator", "general_knowledge", "hybrid", "rag", "web_search",
    ]


def test_outcomes_and_summaries(spark):
    cases = eval_cases(spark)
    responses = [(c["id"], "x" * 300, None) for c in cases.collect() if c["id"] not in ("rag_2", "tool_3", "edge_2")]
    responses += [("rag_2", None, "timeout"), ("tool_3", "half", "cut")]
    outcomes = eval_outcomes(cases, spark.createDataFrame(responses, "id string, response string, error string"))
    rows = {r["id"]: r for r in outcomes.collect()}
    assert rows["edge_2"]["error"] == "no response stored"
    assert len(rows) == 10 and len(rows["rag_1"]["response_preview"]) == 200
    assert (rows["tool_3"]["status"], rows["tool_3"]["response_preview"]) == ("error", None)
    summary = [(r["category"], r["passed"], r["status"]) for r in category_summary(outcomes).collect()]
    assert summary == [
        ("calculator", "2/2", "PASS"),
        ("general_knowledge", "1/2", "FAIL"),
        ("hybrid", "1/1", "PASS"),
        ("rag", "3/4", "FAIL"),
        ("web_search", "0/1", "FAIL"),
    ]
    assert tuple(overall_summary(cases, outcomes).first()) == (10, 7, 3)
    assert {tuple(r) for r in failed_cases(outcomes).collect()} == {("rag_2", "timeout"), ("tool_3", "cut"), ("edge_2", "no response stored")}


def test_failures_without_text(spark):
    df = spark.createDataFrame([("a", "c", "error", None, None)], OUTCOME)
    assert tuple(failed_cases(df).first()) == ("a", "Unknown error")


def test_no_outcomes(spark):
    none = spark.createDataFrame([], OUTCOME)
    assert tuple(overall_summary(eval_cases(spark), none).first()) == (10, 0, 0)
    assert category_summary(none).count() == 0


def test_route_accuracy(spark):
    chosen = [("rag_1", "Retriever Agent", "knowledge_search"), ("rag_2", "General Agent", None),
              ("direct_1", "General Agent", None), ("edge_2", "General Agent", "calculator")]
    accuracy = route_accuracy(eval_cases(spark), spark.createDataFrame(chosen, "id string, agent string, tool string"))
    got = {tuple(r) for r in accuracy.collect()}
    assert got == {
        ("Retriever Agent", "Retriever Agent", 1, 1, True),
        ("Retriever Agent", "General Agent", 1, 0, False),
        ("Retriever Agent", None, 2, 0, False),
        ("General Agent", "General Agent", 2, 1, True),
        ("General Agent", None, 4, 0, False),
    }
    table = confusion_table(accuracy, ["Retriever Agent", "General Agent"]).collect()
    assert {tuple(r) for r in table} == {("Retriever Agent", 1, 1), ("General Agent", 0, 2)}


def test_context_blocks(spark):
    hits = spark.createDataFrame(
        [(1, 2, 7, 0.25, "second"), (1, 1, 3, 0.00012, "first")],
        "query_id int, rank int, page_num int, score double, content string",
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r["query_id"]: r["context"] for r in format_context(queries, hits).collect()}
    assert got[1] == "[Chunk 1] (Page 3, Score: 0.0001)\nfirst\n\n[Chunk 2] (Page 7, Score: 0.2500)\nsecond"
    assert got[2] == NO_CONTEXT == "No relevant context found in the knowledge base."


NODE = (
    "response_id int, node_id string, parent_id string, position int, kind string, name string, content string"
)
S = "knowledge_search"


def run(r):
    return (r, "root", None, 0, "run", None, None)


def member(r, node, parent, position):
    return (r, node, parent, position, "member", "agent", None)


def tool(r, parent, position, content, name=S):
    return (r, f"{parent}/t{position}", parent, position, "tool", name, content)


def message(r, parent, position, content, name=S):
    return (r, f"{parent}/m{position}", parent, position, "message", name, content)


def test_order_of_retrieved_results(spark):
    nodes = [
        # Own tools come first, the lowest position with a result wins.
        run(1), tool(1, "root", 2, "late"), tool(1, "root", 1, "own"), tool(1, "root", 0, ""),
        tool(1, "root", 3, "x", "calculator"), member(1, "a", "root", 0), tool(1, "a", 0, "member's"),
        # A member's whole subtree, messages included, comes before the next member.
        run(2), member(2, "a", "root", 0), member(2, "b", "root", 1), member(2, "aa", "a", 0),
        message(2, "aa", 0, "deep message"), tool(2, "b", 0, "next member"), message(2, "root", 0, "own message"),
        # A member's tools come before its members, a run's messages after all of them.
        run(3), member(3, "a", "root", 0), member(3, "aa", "a", 0), tool(3, "aa", 0, "nested"),
        tool(3, "a", 5, "upper"), message(3, "root", 0, "message"),
        # Only the first message of the tool counts; if it is empty the next member is asked.
        run(4), member(4, "a", "root", 0), member(4, "b", "root", 1), message(4, "a", 0, "other", "calculator"),
        message(4, "a", 1, None), message(4, "a", 2, "second"), message(4, "b", 0, "from b"),
        # Nothing found.
        run(5), tool(5, "root", 0, None), message(5, "root", 0, ""),
        # Positions compare as numbers.
        run(6), *[member(6, f"m{i}", "root", i) for i in range(12)], tool(6, "m10", 0, "ten"), tool(6, "m9", 0, "nine"),
    ]
    got = retrieved_context(spark.createDataFrame(nodes, NODE).repartition(4), max_depth=3)
    assert {r["response_id"]: r["context"] for r in got.collect()} == {
        1: "own", 2: "deep message", 3: "upper", 4: "from b", 5: None, 6: "nine",
    }


def test_runs_nested_too_deep_are_an_error(spark):
    nodes = [run(1), member(1, "a", "root", 0), member(1, "b", "a", 0), member(1, "c", "b", 0), tool(1, "c", 0, "x")]
    df = spark.createDataFrame(nodes, NODE)
    assert retrieved_context(df, max_depth=3).first()["context"] == "x"
    with pytest.raises(Exception, match="nested more than 2 deep"):
        retrieved_context(df, max_depth=2).collect()


def test_runs_of_any_depth_and_roles(spark):
    inner = [f"m{i}" for i in range(12)]
    nodes = [run(1), *[member(1, child, parent, 0) for parent, child in zip(["root", *inner], inner)]]
    nodes += [tool(1, inner[-1], 0, "deep")]
    nodes += [run(2), message(2, "root", 0, "asked"), message(2, "root", 1, "found")]
    df = spark.createDataFrame(nodes, NODE)
    assert {r["response_id"]: r["context"] for r in retrieved_context(df).collect()} == {1: "deep", 2: "asked"}
    role = F.when(F.col("content") == "asked", "user").otherwise("tool")
    got = retrieved_context(df.withColumn("role", role)).collect()
    assert {r["response_id"]: r["context"] for r in got} == {1: "deep", 2: "found"}
    circle = [run(1), member(1, "a", "b", 0), member(1, "b", "a", 0), tool(1, "a", 0, "x")]
    with pytest.raises(ValueError, match="nested"):
        retrieved_context(spark.createDataFrame(circle, NODE))


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """Fifty deep: seven doublings; and a run that holds most of the nodes."""
    from lectern.operators import evaluation

    paths = []
    monkeypatch.setattr(evaluation, "scratch_path", lambda s, n, f=evaluation.scratch_path: paths.append(n) or f(s, n))
    inner = [f"m{i}" for i in range(50)]
    nodes = [run(1), *[member(1, child, parent, 0) for parent, child in zip(["root", *inner], inner)]]
    nodes += [tool(1, inner[-1], 0, "deepest"), message(1, inner[30], 0, "halfway")]
    nodes += [run(2), member(2, "wide", "root", 5)]
    nodes += [n for i in range(3000) for n in (member(2, f"w{i}", "wide", i), tool(2, f"w{i}", 0, f"text {i}" if i > 1500 else ""))]
    nodes += [run(3), tool(3, "root", 0, "own")]
    df = spark.createDataFrame(nodes, NODE).repartition(5)
    got = {r["response_id"]: r["context"] for r in retrieved_context(df).collect()}
    assert got == {1: "deepest", 2: "text 1501", 3: "own"}
    assert paths.count("ways") - 1 <= 7
    assert retrieved_context(df, max_depth=50).count() == 3
    with pytest.raises(ValueError, match="more than 49 deep"):
        retrieved_context(df, max_depth=49)


def test_evaluation_plan(spark):
    from lectern.plans.evaluation import evaluate

    cases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "id string, category string")
    responses = spark.createDataFrame(
        [("a", "fine", None), ("c", None, None), ("d", "t", "broken"), ("z", "no case", None)],
        "id string, response string, error string",
    )
    nodes = spark.createDataFrame(
        [
            ("a", "r", None, 0, "run", None, None),
            ("a", "t", "r", 0, "tool", "knowledge_search", "found"),
            ("c", "r", None, 0, "run", None, None),
        ],
        "response_id string, node_id string, parent_id string, position int, kind string, name string, content string",
    )
    report = evaluate(cases, responses, nodes)
    got = {r["id"]: (r["status"], r["response_preview"], r["error"], r["context"]) for r in report.outcomes.collect()}
    assert got == {
        "a": ("completed", "fine", None, "found"),
        "b": ("error", None, "no response stored", None),
        "c": ("completed", "No response", None, None),
        "d": ("error", None, "broken", None),
    }
    assert [tuple(r)[3:] for r in report.categories.collect()] == [("0/1", "FAIL"), ("1/2", "FAIL"), ("1/1", "PASS")]
    assert tuple(report.overall.first()) == (4, 2, 2)
    assert {tuple(r) for r in report.failures.collect()} == {("b", "no response stored"), ("d", "broken")}
    assert report.category_names.count() == 3
