"""Every operator on nulls, empty, long and repeated texts, on empty tables and beside clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, decontamination, langid, lines, quality, secret_scan, simhash, substrings, toxicity, url_filter
from lectern.llm.queries import URL_RULES, public_tokenizer

LONG = "the quick brown fox jumps over lazy dogs near a river bank at dawn " * 3000
ROWS = [
    (1, "One line that says a thing or two about rivers.", "en", "a"),
    (1, "One line that says a thing or two about rivers.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "A row without a number that still has some words.", "de", None),
    (None, None, None, None),
    (5, " \t\n\x0b\x0c\r ", None, "b"),
    (6, LONG, "en", "hot"),
    (7, "x" * 300_000, "en", "hot"),
    (8, "İstanbul’da 𝒳 日本語 \u0000 tail", "tr", "hot"),
    (9, "One line that says a thing or two about rivers.", "en", "a"),
]
# Names that the operators use for columns of their own.
CLASHES = [
    "id", "row", "h", "fp", "key", "n", "k", "kind", "_text", "_words", "_doc", "_gone", "_key", "score", "spans",
    "lang_pred", "taught", "stratum", "kept", "component_id", "shard", "place", "n_words", "host", "count",
]


def documents(spark, rows=ROWS):
    schema = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def labels(spark, rows=((1, 1, 0), (1, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def items(spark, rows=((1, "thing or two about rivers"), (2, None), (3, ""), (None, "words"), (1, "a thing or two"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "simhash": lambda s, d, empty: simhash.near_copies(d),
    "langid": lambda s, d, empty: langid.identify(d),
    "toxicity": lambda s, d, empty: toxicity.judge(d, labels(s, []) if empty else labels(s)),
    "quality": lambda s, d, empty: quality.judge(d, labels(s, []) if empty else labels(s)),
    "substrings": lambda s, d, empty: substrings.cut_repeats(d),
    "secret_scan": lambda s, d, empty: secret_scan.scan(d),
    "lines": lambda s, d, empty: lines.cut_lines(d),
    "decontamination": lambda s, d, empty: decontamination.decontaminate(d, items(s, []) if empty else items(s)),
    "bpe": lambda s, d, empty: bpe.encode(d, **public_tokenizer()),
    "url_filter": lambda s, d, empty: url_filter.judge(
        d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}),
        (labels(s, []) if empty else labels(s)).select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad")),
        URL_RULES,
    ),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    """Odd rows, also as the only one and repeated, give a row each; equal rows give equal results."""
    got = OPERATORS[name](spark, documents(spark), False).collect()
    id = "page_id" if name == "url_filter" else "doc_id"
    assert sorted(str(r[id]) for r in got) == sorted(str(r[0]) for r in ROWS)
    twice = [r.asDict(recursive=True) for r in got if r[id] == 1]
    drop = {"place", "shard", "row"}
    assert [{k: v for k, v in r.items() if k not in drop} for r in twice[:1]] == [
        {k: v for k, v in r.items() if k not in drop} for r in twice[1:]
    ]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark, []), True).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_without_anything_to_learn_or_find(spark, name):
    """Documents beside empty labels and benchmark tables."""
    assert OPERATORS[name](spark, documents(spark), True).count() == len(ROWS)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages(spark, tmp_path, stage, rows):
    """Stages keep their columns, clashing ones too, and never make rows."""
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    got = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns
    assert got.count() <= len(rows)
