import random

import pyarrow.parquet as pq

import corpus_pipeline
from lectern.llm import decontamination
from tests.conftest import plan_of


def test_few_shards_are_written_and_read_at_once(spark):
    """What lies in one group of rows is in the memory of its writer and its reader as a whole."""
    rng = random.Random(7)
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(20_000))) for i in range(60)]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    groups = []
    for name in index.inputFiles():
        kept = pq.ParquetFile(name.removeprefix("file://")).metadata
        groups += [kept.row_group(i) for i in range(kept.num_row_groups)]
    shards = sum(g.num_rows for g in groups)
    held = sum(g.total_byte_size for g in groups)
    assert shards > 5 and held > 8 * 2**20
    # A group ends once it is full, so it is larger by one shard at most.
    assert max(g.total_byte_size for g in groups) <= 4 * 2**20 + 1.5 * held / shards


def test_a_shard_is_read_as_it_was_stored(spark):
    docs = [(1, "b a b"), (2, None), (None, "a c"), (2, "")]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1))
    row = index.toArrow()
    assert row.column("doc_ids").to_pylist() == [[1, 2, None, 2]] and row.column("n_words").to_pylist() == [[3, 0, 2, 0]]
    terms, n_docs, sizes = (x.to_pylist() for x in decontamination._unpacked(row.column("terms")[0]))
    postings, at, listed = decontamination._unpacked(row.column("postings")[0])[0].to_numpy().cumsum().tolist(), 0, {}
    for term, n, size in zip(terms, n_docs, sizes, strict=True):
        listed[term], at = (n, postings[at : at + size]), at + size
    assert listed == {b"a": (2, [1, 5]), b"b": (1, [0, 2]), b"c": (1, [6])}


def test_texts_are_not_shuffled_to_drop_some_of_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)] + [(None, None)], "doc_id bigint, text string")
    gone = docs.where("doc_id % 3 = 0").select(corpus_pipeline._key().alias("doc_id"))
    kept = sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id % 3 != 0").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        few = corpus_pipeline._without(docs, gone)
        assert "Exchange hashpartitioning" not in plan_of(few) and "BroadcastHashJoin" in plan_of(few)
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 5)
        many = corpus_pipeline._without(docs, gone)
        assert "BroadcastHashJoin" not in plan_of(many)
        for found in (few, many):
            rows = [(r["doc_id"], r["text"]) for r in found.collect()]
            assert (None, None) in rows and sorted(r for r in rows if r[0] is not None) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
