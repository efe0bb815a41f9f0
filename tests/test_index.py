import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.operators.filters import may_be_in
from lectern.operators.embedding import hash_embed
from lectern.plans.knowledge import answer, build_index, index_rows, search_texts, update_index
from lectern.sources.index import (
    INDEX_SCHEMA,
    check_dimension,
    check_unique,
    clear_index,
    compact_index,
    create_index,
    ensure_index,
    ids_stored,
    index_count,
    known_pages,
    scan_index,
    stored_rows,
    write_index,
)
from lectern.streaming.index_stream import stream_index

PAGE = "source string, page_num int, content string"


def small(df):
    return hash_embed(df, 32)


def flat(df):
    """Vectors of one component, where only rows matter."""
    return df.withColumn("embedding", F.array(F.length("content").cast("float")))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [("a", 1, "cats and dogs " * 100), ("a", 2, "stars and planets " * 30), ("b", 1, "bread")], PAGE
    )


def test_create_clear_count(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    assert index_count(spark, path) == 0
    create_index(spark, path)
    assert scan_index(spark, path).schema == INDEX_SCHEMA
    rows = index_rows(pages, small)
    assert write_index(rows, path) == (4, 4)
    create_index(spark, path)
    assert index_count(spark, path) == 4
    other = rows.where("source = 'b'").withColumn("id", F.lit("other"))
    assert write_index(other, path, "append") == (1, 5)
    assert write_index(rows, path) == (4, 4)
    clear_index(spark, path)
    assert index_count(spark, path) == 0
    with pytest.raises(ValueError):
        write_index(rows, path, "ignore")


def test_indexing_again_adds_only_what_is_new(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    assert build_index(pages.where("source = 'a'"), path, flat) == (3, 3)
    assert build_index(pages, path, flat, recreate=False) == (1, 4)
    assert build_index(pages, path, flat, recreate=False) == (0, 4)
    assert check_unique(scan_index(spark, path)).count() == 0


def contents(spark, path):
    return sorted((r["source"], r["page_num"], r["content"]) for r in scan_index(spark, path).collect())


def test_updates_replace_insert_remove_and_bring_back(spark, tmp_path):
    path = str(tmp_path / "index")

    def book(*texts, source="book"):
        return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], PAGE)

    build_index(book("one", "three").unionByName(book("kept", source="other")), path, flat)
    assert build_index(book("one", "two", "three"), path, flat, recreate=False) == (2, 4)
    now = [("book", 1, "one"), ("book", 2, "two"), ("book", 3, "three"), ("other", 1, "kept")]
    assert contents(spark, path) == now
    # Back to what was there before: no row is stored twice.
    assert build_index(book("one", "three"), path, flat, recreate=False) == (1, 3)
    assert contents(spark, path) == [("book", 1, "one"), ("book", 2, "three"), ("other", 1, "kept")]
    # A page without text loses its chunks; rows that come twice are stored once.
    assert build_index(book("", "new").union(book("", "new")), path, flat, recreate=False) == (1, 2)
    assert contents(spark, path) == [("book", 2, "new"), ("other", 1, "kept")]
    assert check_unique(scan_index(spark, path)).count() == 0
    # Single pages leave the rest of their source alone.
    one = spark.createDataFrame([(None, 1, "none"), ("book", 9, "nine")], PAGE)
    update_index(one, path, flat, given=("source", "page_num"))
    update_index(one.replace("none", "other none", "content"), path, flat, given=("source", "page_num"))
    found = {(r["source"], r["page_num"], r["content"]) for r in scan_index(spark, path).collect()}
    assert found == {("book", 2, "new"), ("book", 9, "nine"), ("other", 1, "kept"), (None, 1, "other none")}
    clear_index(spark, path)
    assert index_count(spark, path) == 0


def test_writes_of_another_width_fail_and_add_nothing(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    write_index(index_rows(pages, small), path, dim=32)
    with pytest.raises(Exception, match="not 32 wide"):
        other = pages.withColumn("source", F.concat("source", F.lit(" again")))
        write_index(index_rows(other, lambda df: hash_embed(df, 16)), path, "append", dim=32)
    assert index_count(spark, path) == 4


def test_ensure_builds_once(spark, tmp_path, pages):
    path, built = str(tmp_path / "index"), []

    def build():
        built.append(1)
        return index_rows(pages, small)

    assert ensure_index(spark, path, build).count() == 4
    assert ensure_index(spark, path, build).count() == 4
    assert built == [1]


def test_only_used_columns_are_read(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    build_index(pages, path, small)
    plan = scan_index(spark, path).where("page_num = 2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,page_num:int>" in plan
    assert "EqualTo(page_num,2)" in plan


def test_checks(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [1.0]), ("b", None), ("c", [])], "id string, embedding array<float>"
    )
    assert [tuple(r) for r in check_unique(df).collect()] == [("a", 2)]
    bad = {tuple(r) for r in check_dimension(df, 2).collect()}
    assert bad == {("a", 1), ("b", None), ("c", 0)}


def test_answers_from_an_index_that_is_built_on_demand(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    queries = spark.createDataFrame([(1, "planets and stars"), (2, "dogs")], "query_id int, content string")
    got = {r["query_id"]: r["context"] for r in answer(spark, path, queries, pages, small, k=2).collect()}
    assert got[1].startswith("[Chunk 1] (Page 2, Score: ")
    assert "\n\n[Chunk 2] (Page " in got[1]
    assert "cats and dogs" in got[2]
    again = answer(spark, path, queries, embed=small, k=2).collect()
    assert {r["query_id"]: r["context"] for r in again} == got


def test_stream_equals_batch_and_repeats_add_nothing(spark, tmp_path, pages):
    arriving, index = str(tmp_path / "pages"), str(tmp_path / "index")
    batch = str(tmp_path / "batch")
    build_index(pages, batch, small)

    def run(progress):
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(arriving)
        stream_index(stream, index, str(tmp_path / progress), small).awaitTermination()

    pages.repartition(3, "source", "page_num").write.parquet(arriving)
    run("first")
    expected = sorted(map(tuple, scan_index(spark, batch).drop("embedding").collect()))
    assert sorted(map(tuple, scan_index(spark, index).drop("embedding").collect())) == expected
    # A stream that lost its progress reads everything once more.
    run("second")
    assert sorted(map(tuple, scan_index(spark, index).drop("embedding").collect())) == expected
    spark.createDataFrame([("c", 1, "something new")], PAGE).write.mode("append").parquet(arriving)
    run("first")
    assert index_count(spark, index) == len(expected) + 1


def test_scratch_paths_lie_in_the_shared_folder(spark):
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second and first.startswith(session.shared_dir(spark).rstrip("/"))


def test_a_stored_id_fails_the_append(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    rows = index_rows(pages, flat)
    write_index(rows, path)
    for doubled in (rows.where("source = 'b'"), rows.withColumn("id", F.lit("same")), rows.withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="given twice or stored already"):
            write_index(doubled, path, "append")
    with pytest.raises(ValueError, match="given twice"):
        write_index(rows.union(rows), path)
    assert index_count(spark, path) == 4
    assert write_index(rows.limit(0), path, "append") == (0, 4)


def test_stored_ids_are_found_without_a_shuffle_of_the_index(spark, tmp_path, pages):
    path = str(tmp_path / "index")
    write_index(index_rows(pages, flat), path)
    ids = scan_index(spark, path).select("id").limit(2).union(spark.createDataFrame([("zz",), ("00",)], "id string"))
    found = ids_stored(ids, path)
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThanOrEqual(id" in plan
    assert ids_stored(ids.limit(0), path).count() == 0


@pytest.mark.parametrize("count", [3, 2000])
def test_bloom_filter_lets_every_key_pass(spark, count):
    keys = spark.range(2000).select((F.col("id") * 7).cast("string").alias("k"))
    test = may_be_in(keys, "k", count)
    asked = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    passed = {r["k"] for r in asked.where(test(F.col("k"))).collect()}
    assert {str(i) for i in range(0, 14_000, 7)} <= passed
    if count == 2000:
        assert len(passed) < 3000


def numbered(*texts, keys=None):
    keys = range(len(texts)) if keys is None else keys
    return [("book", str(k), i + 1, t) for i, (k, t) in enumerate(zip(keys, texts))]


KEYED = "source string, page_key string, page_num int, content string"


def test_a_page_put_in_front_embeds_one_chunk(spark, tmp_path):
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def counting(df):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return small(df.mapInArrow(count, df.schema))

    texts = [f"page {i} of the book" for i in range(200)]
    assert build_index(spark.createDataFrame(numbered(*texts, keys=range(1, 201)), KEYED), path, counting) == (200, 200)
    assert seen.value == 200
    longer = spark.createDataFrame(numbered("a page in front", *texts, keys=range(201)), KEYED)
    assert build_index(longer, path, counting, recreate=False) == (1, 201)
    assert seen.value == 201
    assert stored_rows(spark, path).count() == 201
    assert [r["page_num"] for r in scan_index(spark, path).orderBy("page_num").collect()] == list(range(1, 202))
    assert {(r["page_key"], r["page_num"]) for r in scan_index(spark, path).collect()} == {(str(i), i + 1) for i in range(201)}
    queries = spark.createDataFrame([(1, "page 7 of the book")], "query_id int, content string")
    hits = search_texts(spark, path, queries, embed=small, k=20).collect()
    assert len(hits) == 20 and all(r["content"] == f"page {r['page_num'] - 2} of the book" for r in hits)
    # Nothing new: nothing is embedded or logged.
    assert build_index(longer, path, counting, recreate=False) == (0, 201)
    assert seen.value == 201


def test_a_page_comes_back_with_another_number(spark, tmp_path):
    path = str(tmp_path / "index")

    def now(*texts, keys):
        build_index(spark.createDataFrame(numbered(*texts, keys=keys), KEYED), path, flat, recreate=False)
        return sorted((r["page_num"], r["content"]) for r in scan_index(spark, path).collect())

    assert now("a", "b", "c", keys="abc") == [(1, "a"), (2, "b"), (3, "c")]
    assert now("b", "c", keys="bc") == [(1, "b"), (2, "c")]
    assert now("b", "c", "a", keys="bca") == [(1, "b"), (2, "c"), (3, "a")]
    assert now("b", "new", "a", keys="bca") == [(1, "b"), (2, "new"), (3, "a")]
    assert now("c", "b", keys="cb") == [(1, "c"), (2, "b")]
    assert {r["page_key"] for r in known_pages(spark, path).collect()} == {"b", "c"}


def test_other_chunk_sizes_cut_all_pages_again(spark, tmp_path, pages):
    path, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")
    build_index(pages, path, flat)
    build_index(pages, path, flat, recreate=False, size=300, overlap=100)
    build_index(pages, fresh, flat, size=300, overlap=100)
    assert contents(spark, path) == contents(spark, fresh)


def test_compaction_folds_the_logs(spark, tmp_path):
    path = str(tmp_path / "index")

    def book(*texts, keys):
        return spark.createDataFrame(numbered(*texts, keys=keys), KEYED)

    build_index(book(*"abcd", keys="abcd"), path, flat)
    assert not compact_index(spark, path)
    build_index(book("x", "a", "B", "c", "d", keys="xabcd"), path, flat, recreate=False)
    before = sorted(map(tuple, scan_index(spark, path).collect()))
    assert stored_rows(spark, path).count() == 6 and len(before) == 5
    assert compact_index(spark, path, share=0.1)
    assert sorted(map(tuple, stored_rows(spark, path).collect())) == before
    assert "Join" not in scan_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, scan_index(spark, path).collect())) == before
    # Updates go on as before, over several generations.
    for text in "ij":
        build_index(book("x", "a", text, "c", "d", keys="xabcd"), path, flat, recreate=False)
        assert compact_index(spark, path, share=0.0)
    assert [c for _, _, c in contents(spark, path)] == ["x", "a", "j", "c", "d"]
    assert write_index(index_rows(book("z", keys="z"), flat), path, "append") == (1, 6)
    clear_index(spark, path)
    assert index_count(spark, path) == 0
    assert build_index(book("x", keys="x"), path, flat, recreate=False) == (1, 1)


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = numbered(*"abc", keys="abc")
    build_index(spark.createDataFrame(rows, KEYED), path, flat)
    build_index(spark.createDataFrame(rows[:1], KEYED), path, flat, recreate=False)  # two of three rows are dead: compacts
    expected = contents(spark, path)
    assert stored_rows(spark, path).count() == 1
    # Files of a generation that never got its marker.
    stored_rows(spark, path).limit(0).write.parquet(f"{path}/_generation-2")
    assert contents(spark, path) == expected
    assert compact_index(spark, path, updates=0)
    assert contents(spark, path) == expected and stored_rows(spark, path).count() == 1


def test_only_pages_with_chunks_under_another_number_are_logged_and_meet_the_log(spark, tmp_path):
    """Updates in a row leave what a fresh index holds, also of pages that come back or change and move at once."""
    page = "source string, page_key string, page_num int, content string"
    texts = {k: f"{k} " * 900 for k in "abcde"}

    def rows(*keys, **revised):
        return spark.createDataFrame([("s", k, i, revised.get(k, texts[k])) for i, k in enumerate(keys, 1)], page)

    def held(path):
        return sorted(tuple(r) for r in scan_index(spark, path).select("id", "page_key", "page_num", "start", "content").collect())

    path, fresh = str(tmp_path / "kept"), str(tmp_path / "fresh")
    build_index(rows("b", "c"), path)
    steps = [
        rows("a", "b", "c", "d", c=texts["c"] + "more"),
        rows("e", "a", "b", "d", "c", a="changed"),
        rows("b", "a", c="x"),
        rows("d", "c", "a", "b", "e", c=texts["c"] + "more"),
    ]
    for i, pages in enumerate(steps):
        build_index(pages, path, recreate=False)
        build_index(pages, fresh)
        assert held(path) == held(fresh)
        if not i:  # c is revised but its first chunks are stored under its earlier number
            assert {r["page_key"] for r in spark.read.parquet(f"{path}/_moved/log").collect()} == {"b", "c"}
    compact_index(spark, path, share=0.0, updates=0)
    assert held(path) == held(fresh) and stored_rows(spark, path).count() == len(held(fresh))
