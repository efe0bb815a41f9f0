import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import matching
from lectern.operators.lookup import LOOKUP_SCHEMA, keyword_lookup
from lectern.operators.matching import key_hits
from lectern.operators.routing import route_queries
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    alphabet = "ab cé.\\E中"
    texts = [(i, "".join(rng.choices(alphabet, k=rng.randrange(0, 60)))) for i in range(150)]
    texts.append((900, None))
    keys = {"".join(rng.choices(alphabet, k=rng.randrange(1, 6))) for _ in range(40)}
    return texts, sorted(keys)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_every_occurrence_is_found(spark, corpus, broadcast_keys):
    texts, keys = corpus
    got = key_hits(
        spark.createDataFrame(texts, "text_id int, text string"),
        spark.createDataFrame(list(enumerate(keys)), "priority int, key string"),
        broadcast_keys=broadcast_keys,
    )
    expected = {(i, p, k) for i, t in texts if t is not None for p, k in enumerate(keys) if k in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_whole_words(spark, corpus, broadcast_keys):
    texts, keys = corpus
    got = key_hits(
        spark.createDataFrame(texts, "text_id int, text string"),
        spark.createDataFrame([(k,) for k in keys], "key string"),
        word=True,
        broadcast_keys=broadcast_keys,
    )

    def stands_alone(text, key):
        at = text.find(key)
        while at >= 0:
            before, after = text[at - 1 : at] if at else "", text[at + len(key) : at + len(key) + 1]
            if not before.isalnum() and not after.isalnum():
                return True
            at = text.find(key, at + 1)
        return False

    expected = {(i, k) for i, t in texts if t is not None for k in keys if stands_alone(t, k)}
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_empty_key_is_part_of_everything(spark, broadcast_keys):
    texts = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "text_id int, text string")
    got = key_hits(texts, spark.createDataFrame([("",), ("a",), (None,)], "key string"), broadcast_keys=broadcast_keys)
    assert {(r["text_id"], r["key"]) for r in got.collect()} == {(1, ""), (2, ""), (1, "a")}
    assert key_hits(texts, spark.createDataFrame([], "key string"), broadcast_keys=broadcast_keys).count() == 0


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_long_texts_repeats_and_a_key_in_most_texts(spark, broadcast_keys, monkeypatch):
    """Hot anchors are salted, batches are cut into stretches, long keys and characters beyond 16 bits match."""
    monkeypatch.setattr(matching, "_PLACES_PER_TASK", 50)
    monkeypatch.setattr(matching, "_STRETCH", 1000)
    long_key = "a very long key " * 40 + "😀 end"
    texts = [(i, "common word " * 3 + ("common" if i % 3 else f"rare{i}")) for i in range(600)]
    texts += [(1000, "x" * 5000 + long_key + "y"), (1001, long_key[:-1]), (1002, "😀")]
    keys = ["common", "common word", "rare3", "rare33", long_key, "😀", "zzz"]
    rows = spark.createDataFrame(texts, "text_id int, text string").repartition(3)
    got = key_hits(rows, spark.createDataFrame([(k,) for k in keys], "key string"), broadcast_keys=broadcast_keys).collect()
    expected = {(i, k) for i, t in texts for k in keys if k in t}
    assert {(r["text_id"], r["key"]) for r in got} == expected and len(got) == len(expected)


def test_few_exchanges(spark):
    """Texts are shuffled once at most where keys can be sent, and never with their pieces."""
    queries = spark.range(500).select("id", F.concat(F.lit("Some Words "), F.col("id").cast("string")).alias("q")).toDF("query_id", "query")
    entries = spark.createDataFrame([(i, f"words {i}", "a", []) for i in range(100)], LOOKUP_SCHEMA)
    terms = spark.createDataFrame([(f"words {i}", "RAG" if i % 2 else "GENERAL") for i in range(100)], "term string, label string")
    for few, exchanges in ((1000, 1), (0, 3)):
        found = keyword_lookup(queries, entries, broadcast_keys=few)
        if few:
            assert plan_of(found).count("Exchange hashpartitioning") <= exchanges
        keys = {r["query_id"]: r["key"] for r in found.collect()}
        wanted = {q: min((int(str(q)[:n]) for n in range(1, len(str(q)) + 1) if int(str(q)[:n]) < 100 and str(int(str(q)[:n])) == str(q)[:n]), default=None) for q in range(500)}
        assert keys == {q: None if w is None else f"words {w}" for q, w in wanted.items()}
        routed = route_queries(queries, terms, inline_terms=0, broadcast_terms=few)
        assert plan_of(routed).count("Exchange hashpartitioning") <= exchanges + 2
        assert routed.where("rag_hits + general_hits > 0").count() == 500


def test_few_places_without_an_anchor_pass(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("abcdefghij ", k=500))) for i in range(200)]
    keys = [f"KEY{i:03d}" for i in range(40)]
    texts += [(1000 + i, f"x{key}y") for i, key in enumerate(keys)]
    met, plain = [], matching._with_places
    monkeypatch.setattr(matching, "_with_places", lambda *given: met.append(plain(*given)) or met[-1])
    got = key_hits(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(k,) for k in keys], "key string"), broadcast_keys=0)
    assert {tuple(r) for r in got.collect()} == {(1000 + i, k) for i, k in enumerate(keys)}
    assert met[-1].count() <= len(keys) + 10
