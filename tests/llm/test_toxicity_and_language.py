import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import langid, toxicity
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog sat here", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (None, "12 %", None), (5, "日本語" * 400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("en", "de")
    assert [(got[i]["lang_pred"], got[i]["rejected"], got[i]["score"]) for i in (3, None)] == [("und", True, 0.0)] * 2
    assert got[5]["rejected"]
    assert langid.identify(docs.limit(0)).count() == 0


def plain_bits(taught, texts):
    """Cross-entropy of each text by the models of each language, counted in dictionaries."""
    counts = {4: Counter(), 3: Counter(), 2: Counter(), 1: Counter()}
    grams = lambda t: [f"   {t} "[i : i + 4] for i in range(len(t) + 1)]
    for t in taught:
        counts[4].update(grams(t))
    for n in (3, 2, 1):
        counts[n].update(g[1:] for g in counts[n + 1])
    total, types, discount = Counter(), Counter(), {}
    for n, own in counts.items():
        for g, c in own.items():
            total[n, g[:-1]] += c
            types[n, g[:-1]] += 1
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 65536
        at, d = (len(g), g[:-1]), discount[len(g)]
        return (max(counts[len(g)][g] - d, 0) + d * types[at] * below) / total[at] if total[at] else below

    return [-sum(math.log2(p(g)) for g in grams(t)) / len(grams(t)) for t in texts]


def test_language_models_grow_with_the_types(spark):
    """Over a million 4-grams of one language, against plain Python; grams by broadcast or by join."""
    dice = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(2000)]
    taught = ["".join(dice.choices(signs, k=20_000)) for _ in range(70)]
    other = ["the cat and the dog sat here", "a dog and a cat"]
    asked = ["".join(dice.choices(signs, k=900)), taught[0][:500], "the dog sat"]
    rows = [(i, t, "zh") for i, t in enumerate(taught)] + [(100 + i, t, "en") for i, t in enumerate(other)]
    rows += [(200 + i, t, None) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    by_language = zip(plain_bits(taught, asked), plain_bits(other, asked), strict=True)
    want = {200 + i: min(pair) for i, pair in enumerate(by_language)}
    found = []
    for head in (langid.HEAD_BYTES, 100_000):
        got = langid.identify(docs, head=head).where("doc_id >= 100").collect()
        found.append({r["doc_id"]: tuple(r) for r in got})
    assert {i: round(found[0][i][3], 5) for i in want} == {i: round(v, 5) for i, v in want.items()}
    assert found[0] == found[1]


def test_toxicity_held_out_recall(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op4_toxicity"](spark, SF).join(labels, "doc_id").where("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) > counts.get((1, 0), 0)
    assert counts.get((0, 1), 0) <= 0.05 * counts[0, 0]


def test_toxicity_spans_and_odd_rows(spark):
    bad = [(i, f"some plain words here number{i}. you utter moron go away now", 1) for i in range(40)]
    good = [(100 + i, f"some plain words here number{i}. the weather is fine go away now", 0) for i in range(40)]
    bad[1] = (1, "İİİ İstanbul. you utter moron go away now", 1)  # longer in lower case
    docs = spark.createDataFrame([*bad, *good, (900, None, 0), (901, "", 0)], "doc_id long, text string, spans int")
    truth = docs.select("doc_id", F.when(F.col("doc_id") < 100, 1).otherwise(0).alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.judge(docs, truth).collect()}
    text = bad[0][1]
    assert [text[s["begin"] : s["end"]] for s in got[0]["spans"] if text[s["begin"] : s["end"]] == "moron"] == ["moron"]
    assert "moron" in [bad[1][1][s["begin"] : s["end"]] for s in got[1]["spans"]]
    assert got[0]["score"] > 0.5 > got[100]["score"]
    assert got[900]["score"] == got[901]["score"] < 0.3
    assert toxicity.judge(docs.limit(0), truth.limit(0)).count() == 0
