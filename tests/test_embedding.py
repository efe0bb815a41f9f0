import hashlib
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding
from lectern.operators.embedding import embed, hash_embed
from tests.conftest import plan_of


def expected(text, dim):
    counts = [0] * dim
    for token in re.findall(r"[^\W_]+", text.lower()):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    length = math.sqrt(sum(c * c for c in counts)) or 1.0
    return [np.float32(c / length) for c in counts]


TEXTS = ["The cat, the CAT and one dog.", "", "--- ... !", "École äöü 中文 x1", "a " * 500, None]


@pytest.mark.parametrize("dim", [8, 384])
def test_hashed_token_counts(spark, dim):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, content string").repartition(2)
    got = {r["n"]: r["embedding"] for r in hash_embed(df, dim).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n] == expected(text or "", dim)


def test_no_tokens_give_a_zero_vector_of_full_width(spark):
    df = spark.createDataFrame([("?!",)], "content string")
    assert hash_embed(df, 16).first()["embedding"] == [0.0] * 16


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "content string")
    assert hash_embed(df).count() == 0


def test_embedding_stays_in_the_scan_stage(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("content"))
    assert "Exchange" not in plan_of(hash_embed(df))


def model():
    def predict(texts):
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    return predict


def test_supplied_model(spark):
    df = spark.createDataFrame([("banana",), ("kiwi",)], "content string")
    got = {r["content"]: r["embedding"] for r in embed(df, model, batch_size=1).collect()}
    assert got == {"banana": [6.0, 3.0], "kiwi": [4.0, 0.0]}


def test_a_batch_of_long_texts_is_embedded_in_bounded_memory():
    words = [f"w{i}" for i in range(500)]
    texts = pa.array([" ".join(words[(i * 7 + j) % 500] for j in range(400)) for i in range(4000)] + [None, "", " !"])
    vectors = embedding._token_vectors(16)
    vectors(texts[:10])
    tracemalloc.start()
    try:
        whole = vectors(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * texts.nbytes
    for at in (0, 1234, 3999, 4000, 4001, 4002):
        assert whole[at].as_py() == vectors(texts[at : at + 1])[0].as_py()


def test_stretches_cover_a_batch_once(monkeypatch):
    monkeypatch.setattr(embedding, "_STRETCH", 10)
    for texts in ([], [None], ["a" * 50, "", None, "b" * 9, "c", "d"], ["é" * 6] * 3):
        runs = list(embedding._stretches(pa.array(texts, pa.string())))
        assert [i for begin, end in runs for i in range(begin, end)] == list(range(len(texts)))
        assert all(end > begin for begin, end in runs)
