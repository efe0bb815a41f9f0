"""Evaluation: cases, outcomes, what was retrieved, and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import preview
from lectern.session import scratch_path

CASE_SCHEMA = (
    "id string, query string, expected_agent string, expected_tool string, "
    "category string, success_criteria string"
)

# The evaluation cases.
CASES = [
    (
        "rag_1",
        "What is cross-validation and why is it important in machine learning?",
        "Retriever Agent",
        "knowledge_search",
        "rag",
        "Answer mentions k-fold, train/test split, and cites textbook content",
    ),
    (
        "rag_2",
        "Explain the difference between supervised and unsupervised learning",
        "Retriever Agent",
        "knowledge_search",
        "rag",
        "Distinguishes labeled vs unlabeled data, gives examples",
    ),
    (
        "rag_3",
        "How do random forests prevent overfitting compared to single decision trees?",
        "Retriever Agent",
        "knowledge_search",
        "rag",
        "Mentions ensemble, bagging, feature randomization",
    ),
    (
        "rag_4",
        "What preprocessing steps does scikit-learn provide?",
        "Retriever Agent",
        "knowledge_search",
        "rag",
        "Mentions StandardScaler, MinMaxScaler, or similar sklearn tools",
    ),
    (
        "tool_1",
        "What is 127 * 53 + 89?",
        "General Agent",
        "calculator",
        "calculator",
        "Returns 6820 (127*53=6731, +89=6820)",
    ),
    (
        "tool_2",
        "Convert 98.6 degrees Fahrenheit to Celsius",
        "General Agent",
        "calculator",
        "calculator",
        "Returns 37.0 (body temperature)",
    ),
    (
        "tool_3",
        "Search the web for the latest developments in large language models",
        "General Agent",
        "web_search",
        "web_search",
        "Returns search results (real or mock)",
    ),
    (
        "direct_1",
        "What is the capital of Japan?",
        "General Agent",
        None,
        "general_knowledge",
        "Returns 'Tokyo' without using any tool",
    ),
    (
        "edge_1",
        "Calculate the square root of the number of features in a typical iris dataset",
        "General Agent",
        "calculator",
        "hybrid",
        "Identifies 4 features, calculates sqrt(4)=2",
    ),
    (
        "edge_2",
        "What is the meaning of life?",
        "General Agent",
        None,
        "general_knowledge",
        "Answers philosophically, does not search the knowledge base",
    ),
]

# The tool whose results count as retrieved context, and the default error text.
SEARCH_TOOL = "knowledge_search"
UNKNOWN_ERROR = "Unknown error"
NO_RESPONSE = "No response"

NOT_STORED = "no response stored"

COMPLETED = "completed"
ERROR = "error"


def eval_cases(spark: SparkSession) -> DataFrame:
    """The built-in cases."""
    return spark.createDataFrame(CASES, CASE_SCHEMA)


def eval_outcomes(cases: DataFrame, responses: DataFrame, width: int = 200) -> DataFrame:
    """``(id, category, status, response_preview, error)``, one row per response to a case.

    ``responses`` has ``id, response, error``. A response with an error has no preview, one without
    a text that of NO_RESPONSE. A case without any response is an error.
    """
    failed = F.col("error").isNotNull()
    text = F.coalesce("response", F.lit(NO_RESPONSE))
    answered = responses.select("id", "response", "error", F.lit(True).alias("_answered"))
    return (
        cases.select("id", "category")
        .join(answered, "id", "left")
        .withColumn("error", F.when(F.col("_answered"), F.col("error")).otherwise(NOT_STORED))
        .select(
            "id",
            "category",
            F.when(failed, ERROR).otherwise(COMPLETED).alias("status"),
            F.when(~failed, preview(text, width)).alias("response_preview"),
            "error",
        )
    )


def category_summary(outcomes: DataFrame) -> DataFrame:
    """Per category, sorted: completed of total, and PASS only if all are completed."""
    return (
        outcomes.groupBy("category")
        .agg(
            F.count_if(F.col("status") == COMPLETED).alias("completed"),
            F.count(F.lit(1)).alias("total"),
        )
        .select(
            "category",
            "completed",
            "total",
            F.concat_ws("/", "completed", "total").alias("passed"),
            F.when(F.col("completed") == F.col("total"), "PASS").otherwise("FAIL").alias("status"),
        )
        .orderBy("category")
    )


def overall_summary(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: number of cases (not of outcomes), completed, errors."""
    done = F.col("status") == COMPLETED
    none = F.lit(0)
    return (
        cases.select(F.lit(1).alias("case"), none.alias("done"), none.alias("failed"))
        .union(outcomes.select(none, F.when(done, 1).otherwise(0), F.when(done, 0).otherwise(1)))
        .agg(
            F.coalesce(F.sum("case"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("done"), F.lit(0)).alias("completed"),
            F.coalesce(F.sum("failed"), F.lit(0)).alias("errors"),
        )
    )


def distinct_categories(outcomes: DataFrame) -> DataFrame:
    """The categories that occur, sorted."""
    return outcomes.select("category").distinct().orderBy("category")


def failed_cases(outcomes: DataFrame) -> DataFrame:
    """``(id, error)`` of every failure."""
    return outcomes.where(F.col("status") == ERROR).select(
        "id", F.coalesce("error", F.lit(UNKNOWN_ERROR)).alias("error")
    )


def route_accuracy(cases: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per expected and chosen agent: number of cases, and of those with the expected tool.

    ``chosen`` has ``id, agent, tool``. Cases without a choice are counted with a null agent;
    an expected tool of null means that none should be used.
    """
    tool_right = F.col("id_chosen").isNotNull() & F.col("expected_tool").eqNullSafe(F.col("tool"))
    return (
        cases.select("id", "expected_agent", "expected_tool")
        .join(chosen.select(F.col("id").alias("id_chosen"), "agent", "tool"), F.col("id") == F.col("id_chosen"), "left")
        .groupBy("expected_agent", "agent")
        .agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(tool_right).alias("n_tool_right"))
        .withColumn("right", F.col("expected_agent").eqNullSafe(F.col("agent")))
    )


def confusion_table(accuracy: DataFrame, agents: list[str]) -> DataFrame:
    """``route_accuracy`` with one column per chosen agent."""
    return accuracy.groupBy("expected_agent").pivot("agent", agents).agg(F.sum("n_cases")).fillna(0, agents)


def _ways_from_root(members: DataFrame, at: Column, max_depth: int | None) -> DataFrame:
    """``_response, _member, _way``: the steps that lead from the root to each nested run."""
    spark = members.sparkSession
    current = members.select(
        F.col("response_id").alias("_response"),
        F.col("node_id").alias("_member"),
        F.col("parent_id").alias("_above"),
        F.array(F.struct(F.lit(2).alias("section"), at.alias("at"))).alias("_way"),
        F.lit(True).alias("_open"),
    )
    # A way of 2**62 steps is in a circle; with a limit, fewer rounds show that it is passed.
    for doubled in range(62 if max_depth is None else max(0, max_depth - 1).bit_length() + 2):
        path, seen = scratch_path(spark, "ways"), Observation()
        counts = [F.count_if("_open").alias("open"), F.max(F.when(~F.col("_open"), F.size("_way"))).alias("depth"), F.count(F.lit(1)).alias("n")]
        current.observe(seen, *counts).write.parquet(path)
        state, current = seen.get, spark.read.schema(current.schema).parquet(path)
        if max_depth is not None and (state["depth"] or 0) > max_depth:
            break
        if not state["open"]:
            return current.select("_response", "_member", "_way")
        above = current.select(
            F.col("_response").alias("_r"),
            F.col("_member").alias("_m"),
            F.col("_above").alias("_higher"),
            F.col("_way").alias("_longer"),
            F.col("_open").alias("_more"),
        )
        climbing = current.where("_open").join(above, (F.col("_response") == F.col("_r")) & (F.col("_above") == F.col("_m")), "left")
        nested = F.col("_m").isNotNull()
        climbed = climbing.select(
            "_response",
            "_member",
            F.when(nested, F.col("_higher")).otherwise(F.col("_above")).alias("_above"),
            F.when(nested, F.concat("_longer", "_way")).otherwise(F.col("_way")).alias("_way"),
            (nested & F.col("_more")).alias("_open"),
        )
        # More steps than there are runs: a circle.
        if state["n"] and doubled > state["n"].bit_length():
            break
        current = climbed.unionByName(current.where("not _open"))
    raise ValueError("runs are nested in a circle" if max_depth is None else f"a run is nested more than {max_depth} deep")


def retrieved_context(nodes: DataFrame, tool: str = SEARCH_TOOL, max_depth: int | None = None) -> DataFrame:
    """``(response_id, context)``: the first non-empty search result of each run, null if none.

    ``nodes`` holds the run trees flat: ``response_id, node_id, parent_id, position, kind,
    name, content`` with kind ``run`` (the root), ``member`` (a nested run), ``tool`` or
    ``message`` (their ``parent_id`` is the run they belong to); ``node_id`` is unique within a
    response, ``position`` within its parent and kind. The order is: tools of a run, then its
    members one after the other with everything below them, then its messages. Only the first
    message of the tool counts for a run; empty results are passed over.

    Runs find their way from the root by pointer doubling: each points to the run above it, then to the one two
    above, four, eight …, and joins the ways, so that the number of rounds grows with the logarithm of the depth;
    runs that have reached the root leave the loop. The first result of each run then has its whole way, and
    the least one of a response wins. Texts are fetched for the winners only. With ``max_depth``, a run
    nested deeper is an error; runs that lie within each other in a circle always are. If there is a column
    ``role``, messages of other roles than ``tool`` do not count.
    """
    named = nodes.where(F.col("name") == tool)
    if "role" in nodes.columns:
        named = named.where((F.col("kind") != "message") | (F.col("role") == "tool"))
    filled = F.coalesce(F.length("content") > 0, F.lit(False))
    at = F.col("position").cast("long")

    def first_of_run(kind: str, section: int) -> DataFrame:
        found = named.where(F.col("kind") == kind)
        if kind == "tool":
            found = found.where(filled)
        return (
            found.groupBy("response_id", F.col("parent_id").alias("run"))
            .agg(F.min_by(F.struct("node_id", at.alias("at"), filled.alias("filled")), at).alias("first"))
            .where("first.filled")
            .select(
                "response_id",
                "run",
                F.array(F.struct(F.lit(section).alias("section"), "first.at")).alias("way"),
                "first.node_id",
            )
        )

    found = first_of_run("tool", 1).unionByName(first_of_run("message", 3))
    ways = _ways_from_root(nodes.where(F.col("kind") == "member"), at, max_depth)
    inside = (F.col("response_id") == F.col("_response")) & (F.col("run") == F.col("_member"))
    whole = F.concat(F.coalesce("_way", F.array().cast(ways.schema["_way"].dataType)), F.col("way"))
    placed = found.join(ways, inside, "left").select("response_id", whole.alias("way"), "node_id")
    first = placed.groupBy("response_id").agg(F.min_by("node_id", "way").alias("node_id"))
    texts = named.where(filled).select("response_id", "node_id", F.col("content").alias("context"))
    return (
        nodes.where(F.col("kind") == "run")
        .select("response_id")
        .join(first.join(texts, ["response_id", "node_id"]).drop("node_id"), "response_id", "left")
    )
