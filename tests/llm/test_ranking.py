"""Ranked search against scores of every document for every item."""

import math
import random
import re

import pytest

from lectern.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    found = [(d, terms(t)) for d, t in docs]
    found = [x for x in found if x[1]]
    n, total = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    by_id = {}
    for item, text in items:
        by_id.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in by_id.items():
        scored = []
        for d, w in found:
            m = 100 - 90 + (90 * len(w) * n) // total
            score = 0
            for t in wanted & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def told(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "x1", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 5, 5, 9, 40])))) for i in range(300)]
    docs += [(1000 + i, "w1 w2, w3 w59") for i in range(150)] + [(5, "w59 w58"), (5, "w59 w58"), (None, "w59"), (None, None), (9, ""), (10, "?! .")]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(20)]
    items += [(0, "w58 w58 w58"), (None, "w59 the"), (77, None), (78, "unknown words"), (79, "")]
    return docs, items


@pytest.mark.parametrize(("row_bytes", "visits", "block_bytes", "k"), [(8 << 20, 4, 8 << 20, 10), (200, 1, 100, 3), (1, 2, 1 << 20, 10)])
def test_equals_brute_force(spark, row_bytes, visits, block_bytes, k):
    docs, items = made(4)
    d, i = tables(spark, docs, items)
    index = ranking.build_index(d.repartition(5), row_bytes=row_bytes)
    assert told(ranking.search(index, i, k=k, visits=visits, block_bytes=block_bytes)) == plain(docs, items, k)


def test_rows_hold_one_stratum_and_every_document(spark):
    docs, items = made(6)
    d, _ = tables(spark, docs, items)
    index = ranking.build_index(d, row_bytes=300)
    rows = index.rows.collect()
    lengths = {doc: len(terms(text)) for doc, text in docs if doc is not None and doc < 300 and doc not in (5, 9, 10)}
    for r in rows:
        assert {10 + 90 * lengths[x] * index.n_docs // index.n_terms for x in r["doc_ids"] if x in lengths} <= {r["m"]}
    assert sum(len(r["doc_ids"]) for r in rows) == index.n_docs == sum(bool(terms(t)) for _, t in docs)


def test_long_text_is_read_in_pieces(spark):
    text = "alpha Beta " * 300_000 + "gamma"
    docs, items = [(1, text), (2, "gamma delta")], [(1, "gamma"), (2, "beta gamma")]
    assert [len(w) for w in ranking.terms_of(text.encode())][0] > 1
    d, i = tables(spark, docs, items)
    assert told(ranking.rank(d, i)) == plain(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = made(7)
    d, i = tables(spark, docs, items)
    assert ranking.rank(d.limit(0), i).collect() == []
    assert ranking.rank(d, i.limit(0)).collect() == []
    wide = d.selectExpr("*", "1 as m", "2 as n", "3 as part", "4 as at", "5 as name")
    assert told(ranking.rank(wide, i.selectExpr("*", "7 as id", "8 as doc_id"))) == plain(docs, items)
