"""The operators of this subpackage as queries over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, conversations, decontamination, langid, lines, packing, quality, ranking, secret_scan, simhash, substrings, toxicity, url_filter
from lectern.llm.tasks import held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer() -> dict[str, str]:
    """Paths of the public vocabulary, for the operators that take them."""
    import public_tokenizers

    return {
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "whole": public_tokenizers.path("byte_bpe_50k.json"),
        "pattern": public_tokenizers.PATTERN,
    }


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


# The rules that every url is judged by first.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query
def op2_url_filter(spark, sf_dir):
    """A page is bad where the label filed under its number says low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    found = langid.identify(docs, learn=~F.col("held_out"))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


@query
def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.judge(docs, labels, learn=~held_out(F.col("doc_id")), with_spans=False)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op5_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


@query
def op6_substring_dedup(spark, sf_dir):
    return substrings.cut_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query
def op7_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] <= secret_scan.HEX)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(secret_scan.ASSIGN).alias("n_assign"),
        count(secret_scan.ACCESS).alias("n_access"),
        count(secret_scan.HEX).alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


@query
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.cut_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")


@query
def op9_decontaminate(spark, sf_dir):
    judged = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )


@query
def op10_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), with_values=False, **public_tokenizer())


@query
def op11_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op12_ranked_search(spark, sf_dir):
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns), conversations=turns.select("conv_id"))
