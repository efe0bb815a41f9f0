import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, dot, norm
from lectern.operators import search as searching
from lectern.operators.inverted import choose_probes, search_approx, store_cells
from lectern.operators.search import search, search_batch, search_stats
from tests.conftest import plan_of

CHUNK = "id string, embedding array<float>"
QUERY = "query_id long, embedding array<float>"


def single(x):
    """x as it is stored in single precision."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def score(a, b):
    squares = math.fsum(x * x for x in a) * math.fsum(x * x for x in b)
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(squares) if squares else None


def brute(queries, chunks, k):
    hits = []
    for q, a in queries:
        rows = [(score(a, b), i) for i, b in chunks]
        rows.sort(key=lambda r: (r[0] is None, -round(r[0], 12) if r[0] is not None else 0, r[1]))
        for rank, (s, i) in enumerate(rows[:k], 1):
            hits.append((q, rank, i, None if s is None else math.floor(s * 1e4 + 0.5) / 1e4))
    return sorted(hits)


def vectors(rng, n, dim):
    return [[single(rng.gauss(0, 1)) for _ in range(dim)] for _ in range(n)]


def hits_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())


SPLIT = {"query_bytes": 8 * 8 * 3, "sampled_splits": 1, "broadcast_hits": 0}


@pytest.mark.parametrize("options", [{}, SPLIT])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_both_ways_find_what_brute_force_finds(spark, options, k):
    rng = random.Random(k)
    chunks = [(f"c{i:03d}", v) for i, v in enumerate(vectors(rng, 120, 8))]
    queries = list(enumerate(vectors(rng, 10, 8)))
    got = search_batch(
        spark.createDataFrame(queries, QUERY),
        spark.createDataFrame(chunks, CHUNK).repartition(4),
        k=k,
        **options,
    )
    assert hits_of(got) == brute(queries, chunks, k)


@pytest.mark.parametrize("options", [{}, SPLIT])
def test_many_copies_undefined_vectors_and_ties(spark, options):
    """A third of the rows are copies of one vector, some are zero; a query is zero too."""
    rng = random.Random(1)
    copied = vectors(rng, 1, 8)[0]
    rows = [copied] * 80 + [[0.0] * 8] * 30 + vectors(rng, 130, 8)
    ids = [f"c{i:03d}" for i in range(len(rows))]
    rng.shuffle(ids)
    chunks = list(zip(ids, rows))
    queries = [(0, copied), (1, [0.0] * 8), (2, [2 * x for x in copied])]
    queries += list(enumerate(vectors(rng, 5, 8), 3))
    for k in (3, 7):
        got = search_batch(
            spark.createDataFrame(queries, QUERY), spark.createDataFrame(chunks, CHUNK).repartition(3), k=k, **options
        )
        assert hits_of(got) == brute(queries, chunks, k)


def test_undefined_scores_come_last(spark):
    chunks = [("a", [0.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0])]
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERY)
    got = search_batch(queries, spark.createDataFrame(chunks, CHUNK), k=9)
    assert hits_of(got) == [(1, 1, "b", -1.0), (1, 2, "a", None), (1, 3, "c", None)]
    one = search(spark.createDataFrame(chunks, CHUNK), [1.0, 0.0], k=9)
    assert [tuple(r) for r in one.collect()] == [("b", -1.0), ("a", None), ("c", None)]


@pytest.mark.parametrize("options", [{}, {"query_bytes": 16, "sampled_splits": 1}])
def test_missing_and_unfitting_vectors_are_left_out(spark, options):
    chunks = [("a", None), ("b", [1.0]), ("c", [1.0, 1.0]), ("d", [1.0, float("nan")]), ("e", [1.0, None])]
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0, 1.0])], QUERY)
    got = search_batch(queries, spark.createDataFrame(chunks, CHUNK), k=5, **options)
    assert [(q, i) for q, _, i, _ in hits_of(got)] == [(q, i) for q in (1, 3) for i in "cde"]


def test_single_and_block_search_agree_to_the_bit(spark):
    """Double sums in the same order: near ties fall the same way in both."""
    rng = random.Random(3)
    base = vectors(rng, 1, 16)[0]
    near = [[single(x * (1 + rng.choice([-1, 0, 1]) * 1e-6)) for x in base] for _ in range(300)]
    chunks = spark.createDataFrame([(f"c{i:03d}", v) for i, v in enumerate(near)], CHUNK)
    block = search_batch(spark.createDataFrame([(1, base)], QUERY), chunks, k=40)
    alone = search(chunks, base, k=40)
    assert [i for _, _, i, _ in hits_of(block)] == [r["id"] for r in alone.collect()]


def test_chunk_columns_are_fetched_for_the_hits(spark):
    chunks = spark.createDataFrame(
        [("a", "text a", 3, "s", [1.0, 0.0]), ("b", "text b", 4, "s", [0.0, 1.0])],
        "id string, content string, page_num int, source string, embedding array<float>",
    )
    got = search_batch(spark.createDataFrame([(1, [1.0, 0.1])], QUERY), chunks, k=1)
    assert got.columns == ["query_id", "rank", "id", "content", "page_num", "source", "score"]
    assert got.first()["content"] == "text a"


def test_approximate_hits_are_exact_scores_of_a_part(spark, tmp_path):
    rng = random.Random(9)
    path = str(tmp_path / "cells")
    chunks = [(f"c{i:03d}", v) for i, v in enumerate(vectors(rng, 400, 8))]
    queries = [(i, v) for i, (_, v) in enumerate(chunks[:30])]
    q, c = spark.createDataFrame(queries, QUERY), spark.createDataFrame(chunks, CHUNK)
    store_cells(c, path, cells=8)
    everything = {(h[0], h[2]): h[3] for h in brute(queries, chunks, len(chunks))}
    some = hits_of(search_approx(q, path, k=3, probes=2))
    assert all(everything[h[0], h[2]] == h[3] for h in some)
    # Every query finds itself, which lies in the cell nearest to it.
    assert {(h[0], h[2]) for h in some if h[1] == 1} == {(i, f"c{i:03d}") for i in range(30)}
    # Slabs do not change what is found, and all cells together hold everything.
    assert hits_of(search_approx(q, path, k=3, probes=2, query_bytes=8 * 8 * 14)) == some
    assert hits_of(search_approx(q, path, k=3, probes=8)) == brute(queries, chunks, 3)
    plan = plan_of(search_approx(q.limit(1), path, k=3, probes=1))
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan


def test_recall_is_measured_and_kept(spark, tmp_path):
    """Clustered vectors need few probes; the measured number holds for queries that were not measured."""
    rng = random.Random(4)
    path = str(tmp_path / "cells")
    middles = vectors(rng, 20, 16)
    rows = [[single(x + rng.gauss(0, 0.3)) for x in rng.choice(middles)] for _ in range(1500)]
    chunks = spark.createDataFrame([(f"c{i:04d}", v) for i, v in enumerate(rows)], CHUNK)
    store_cells(chunks, path, cells=32)
    asked = [(i, [single(x + rng.gauss(0, 0.3)) for x in rng.choice(middles)]) for i in range(200)]
    probes, share = choose_probes(spark.createDataFrame(asked[:100], QUERY), path, 0.95)
    assert share >= 0.95 and probes <= 16
    queries = spark.createDataFrame(asked[100:], QUERY)
    exact = {(h[0], h[2]) for h in hits_of(search_batch(queries, chunks))}
    found = {(h[0], h[2]) for h in hits_of(search_approx(queries, path, probes=probes))}
    assert len(found & exact) >= 0.9 * len(exact)


def test_recall_on_the_given_vectors(spark, tmp_path):
    """What the query of the bindings finds: 12 of 16 cells."""
    path = str(tmp_path / "cells")
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    store_cells(given, path, cells=16)
    queries = given.selectExpr("id as query_id", "embedding")
    exact = {(h[0], h[2]) for h in hits_of(search_batch(queries, given))}
    found = {(h[0], h[2]) for h in hits_of(search_approx(queries, path, probes=12))}
    assert len(found & exact) >= 0.9 * len(exact)


def test_crowded_and_empty_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [("a", [1.0, 0.0])] * 1 + [(f"b{i:03d}", [0.5, 0.5]) for i in range(600)] + [("z", [0.0, 0.0]), ("n", None), ("w", [1.0])]
    chunks = spark.createDataFrame(rows, CHUNK)
    store_cells(chunks, path, cells=8, dim=2)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], QUERY)
    got = hits_of(search_approx(queries, path, k=3, probes=8))
    assert got == hits_of(search_batch(queries, chunks, k=3))


def shuffled_rows(spark, df):
    """Rows that the last run of ``df`` wrote to shuffles, from the metrics of its plan."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            plan.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


def test_a_sample_of_splits_bounds_what_the_others_hand_on(spark, tmp_path):
    rng = random.Random(6)
    path, splits, k = str(tmp_path / "chunks"), 64, 5
    chunks = [(f"c{i:05d}", v) for i, v in enumerate(vectors(rng, 64 * 40, 8))]
    spark.createDataFrame(chunks, CHUNK).repartition(splits).write.parquet(path)
    queries = spark.createDataFrame(list(enumerate(vectors(rng, 20, 8))), QUERY)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        stored = spark.read.parquet(path)
        plain = search_batch(queries, stored, k=k, sampled_splits=10**6)
        bounded = search_batch(queries, stored, k=k)
        without, with_bound = shuffled_rows(spark, plain), shuffled_rows(spark, bounded)
        assert hits_of(plain) == hits_of(bounded)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert without >= 20 * k * splits
    assert with_bound <= without / 6


def test_embeddings_are_never_shuffled(spark, tmp_path):
    """Neither side's vectors in any exchange, with one slab or several, and texts behind a filter."""
    rng = random.Random(2)
    path = str(tmp_path / "chunks")
    rows = [(f"c{i}", f"text {i}", v) for i, v in enumerate(vectors(rng, 200, 8))]
    spark.createDataFrame(rows, "id string, content string, embedding array<float>").write.parquet(path)
    chunks = spark.read.parquet(path)
    queries = spark.createDataFrame(list(enumerate(vectors(rng, 12, 8))), QUERY)
    for options in ({}, SPLIT):
        found = search_batch(queries, chunks, k=3, **options)
        for line in plan_of(found).splitlines():
            if "Exchange" in line:
                assert "embedding" not in line and "query#" not in line
        assert found.count() == 36
    assert "ArrowEvalPython" in plan_of(found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_no_query_vectors_no_hits(spark, tmp_path, rows):
    queries = spark.createDataFrame(rows, QUERY)
    chunks = spark.createDataFrame([("a", [1.0, 2.0])], CHUNK)
    assert search_batch(queries, chunks).count() == 0
    store_cells(chunks, str(tmp_path / "cells"), cells=2)
    assert search_approx(queries, str(tmp_path / "cells"), probes=2).count() == 0
    assert choose_probes(queries, str(tmp_path / "cells")) == (1, 1.0)


def test_no_chunks_no_hits(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 2.0])], QUERY)
    chunks = spark.createDataFrame([], CHUNK)
    assert search_batch(queries, chunks).count() == 0
    assert search_batch(queries.union(queries), chunks, query_bytes=1).count() == 0
    store_cells(chunks, str(tmp_path / "cells"), cells=2)
    assert search_approx(queries, str(tmp_path / "cells"), probes=2).count() == 0
    assert search(chunks, [1.0, 2.0]).count() == 0


def test_search_stats(spark):
    hits = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.1)], "query_id int, score double")
    assert {tuple(r) for r in search_stats(hits).collect()} == {(1, 2, 0.5, 0.25), (2, 1, 0.1, 0.1)}


def test_vector_functions(spark):
    row = spark.range(1).select(
        dot(F.lit([1.0, 2.0]), F.lit([3.0, 4.0])).alias("dot"),
        norm(F.lit([3.0, 4.0])).alias("norm"),
        cosine(F.lit([1.0, 0.0]), F.lit([1.0, 1.0])).alias("cosine"),
        cosine(F.lit([0.0, 0.0]), F.lit([1.0, 1.0])).alias("zero"),
        cosine(F.lit([1.0]), F.lit([1.0, 1.0])).alias("widths"),
        cosine(F.lit([1.0, float("nan")]), F.lit([1.0, 1.0])).alias("nan"),
    )
    got = row.first()
    assert (got["dot"], got["norm"]) == (11.0, 5.0)
    assert got["cosine"] == pytest.approx(math.sqrt(0.5))
    assert got["zero"] is None and got["widths"] is None and got["nan"] is None


def test_plans(spark):
    chunks = spark.createDataFrame([("a", "t", [1.0, 0.0])], "id string, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERY)
    assert "TakeOrderedAndProject" in plan_of(search(chunks, [1.0, 0.0]))
    batch = plan_of(search_batch(queries, chunks))
    assert "MapInArrow" in batch and batch.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin" in batch
    assert "CartesianProduct" not in batch and "NestedLoop" not in batch


def test_surplus_copies_keep_the_lowest_ids():
    import numpy as np
    import pyarrow as pa

    best = searching._Best(np.array([[1.0, 0.0]]), k=2)
    matrix = np.array([[1, 0]] * 5 + [[0, 0]] * 4 + [[0.5, 0.5]], dtype=np.float32)
    ids, kept = best._without_surplus_copies(pa.array(list("abcdefghij")), matrix)
    assert ids.to_pylist() == ["a", "b", "f", "g", "j"] and len(kept) == 5


def test_queries_of_several_widths_are_refused_in_any_order(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)]
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<float>")
    for order in (rows, rows[::-1]):
        queries = spark.createDataFrame(order, "query_id int, embedding array<float>")
        with pytest.raises(ValueError, match="1 to 2 wide"):
            search_batch(queries, chunks)
        assert search_batch(queries, chunks, k=2, dim=2).count() == 4


def test_texts_are_read_for_the_best_rows_only(spark, tmp_path):
    rows = [(str(i), f"text {i}", [float(i), 1.0]) for i in range(9)]
    spark.createDataFrame(rows, "id string, content string, embedding array<float>").write.parquet(str(tmp_path / "i"))
    found = search(spark.read.parquet(str(tmp_path / "i")), [1.0, 0.0], k=2)
    assert [(r["id"], r["content"]) for r in found.collect()] == [("8", "text 8"), ("7", "text 7")]
    plan = plan_of(found)
    assert "ReadSchema: struct<id:string,content:string>" in plan
    assert "ReadSchema: struct<id:string,embedding:array<float>>" in plan


def test_many_queries_take_no_more_jobs_than_few(spark):
    rng = random.Random(17)
    chunks = [(f"c{i:03d}", v) for i, v in enumerate(vectors(rng, 150, 8))] + [("nul", None), ("zero", [0.0] * 8)]
    queries = [(i // 2, v) for i, v in enumerate(vectors(rng, 120, 8))]
    asked, stored = spark.createDataFrame(queries, QUERY), spark.createDataFrame(chunks, CHUNK)
    spark.sparkContext.setJobGroup("many queries", "search")
    try:
        got = hits_of(search_batch(asked, stored, k=4, dim=8, **SPLIT))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many queries")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == hits_of(search_batch(asked, stored, k=4, dim=8))


def test_pieces_searched_first_bound_the_others(spark, monkeypatch):
    rng = random.Random(18)
    chunks = [(f"c{i:03d}", v) for i, v in enumerate(vectors(rng, 300, 8))]
    queries = list(enumerate(vectors(rng, 20, 8))) + [(99, [0.0] * 8)]
    monkeypatch.setattr(searching, "_GROUP_BYTES", 8 * 8 * 20)  # 15 pieces, three groups at least
    got = search_batch(spark.createDataFrame(queries, QUERY), spark.createDataFrame(chunks, CHUNK), k=4, **SPLIT)
    assert hits_of(got) == brute(queries, chunks, 4)
