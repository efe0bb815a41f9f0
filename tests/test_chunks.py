import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import WHITESPACE
from lectern.operators.chunks import chunk_pages, index_stats, new_chunks, with_ids
from tests.conftest import plan_of

PAGE = "source string, page_num int, content string"


def pages(spark, *texts):
    return spark.createDataFrame([("book", i + 1, t) for i, t in enumerate(texts)], PAGE)


def starts(spark, text, **options):
    return sorted(r["start"] for r in chunk_pages(pages(spark, text), **options).collect())


def test_white_space_set_is_the_language_definition():
    assert WHITESPACE == "".join(c for c in map(chr, range(0x110000)) if c.isspace())


@pytest.mark.parametrize("text", ["", "   \n\t", " " * 1200, " 　\u001c", None])
def test_nothing_to_keep(spark, text):
    assert starts(spark, text) == []


@pytest.mark.parametrize(
    "length, expected",
    [(800, [0]), (801, [0, 800]), (1000, [0, 800]), (1, [0]), (1600, [0, 800]), (1601, [0, 800, 1600])],
)
def test_windows_at_the_edges(spark, length, expected):
    assert starts(spark, "x" * length) == expected


def test_blank_window_in_the_middle_is_dropped(spark):
    text = "a" * 800 + " " * 1000 + "b" * 10
    assert starts(spark, text) == [0, 1600]


@pytest.mark.parametrize("size, overlap", [(10, 10), (10, 11), (10, -1), (0, 0)])
def test_bad_overlap_is_rejected(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk_pages(pages(spark, "text"), size, overlap)


@pytest.mark.parametrize("size, overlap", [(1000, 200), (7, 3), (5, 0), (9, 8), (1, 0)])
def test_windows_tile_random_text(spark, size, overlap):
    """Each chunk is the trimmed slice at its start, and starts cover the text in steps."""
    rng = random.Random(size * 31 + overlap)
    alphabet = "abcäß中😀  \n　"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40 * size))) for _ in range(12)]
    found = {}
    for row in chunk_pages(pages(spark, *texts), size, overlap).collect():
        found[row["page_num"], row["start"]] = row["content"]
    step = size - overlap
    for number, text in enumerate(texts, 1):
        kept = {start for page, start in found if page == number}
        assert all(start % step == 0 and start < len(text) for start in kept)
        for start in range(0, len(text), step):
            expected = text[start : start + size].strip(WHITESPACE)
            assert found.get((number, start), "") == expected


def test_page_longer_than_one_slice(spark):
    text = "".join(chr(ord("a") + i % 26) for i in range(200_123))
    rows = chunk_pages(pages(spark, text)).orderBy("start").collect()
    assert [r["start"] for r in rows] == list(range(0, len(text), 800))
    assert all(r["content"] == text[r["start"] : r["start"] + 1000] for r in rows)


def test_chunking_needs_no_shuffle_and_trims_once(spark):
    plan = plan_of(with_ids(chunk_pages(pages(spark, "text"))))
    assert "Exchange" not in plan
    assert plan.count("trim(") == 1


def test_ids_are_stable_and_distinct(spark):
    chunks = chunk_pages(pages(spark, "x" * 5000, "x" * 5000))
    first, second = with_ids(chunks), with_ids(chunks)
    ids = [r["id"] for r in first.collect()]
    assert len(set(ids)) == len(ids)
    assert sorted(ids) == sorted(r["id"] for r in second.collect())
    random_ids = [r["id"] for r in with_ids(chunks, deterministic=False).collect()]
    assert len(set(random_ids)) == len(ids) and not set(random_ids) & set(ids)


@pytest.mark.parametrize("broadcast_ids", [0, 10_000])
def test_new_chunks_by_either_way(spark, broadcast_ids):
    both = with_ids(chunk_pages(pages(spark, "a" * 3000, "b" * 900)))
    stored = both.where("page_num = 1")
    left = new_chunks(both, stored, broadcast_ids)
    assert {r["page_num"] for r in left.collect()} == {2}
    assert left.count() == 2
    assert new_chunks(both, both, broadcast_ids).count() == 0
    assert new_chunks(both, both.where(F.lit(False)), broadcast_ids).count() == both.count()


def test_index_stats(spark):
    stats = index_stats(chunk_pages(pages(spark, "a" * 1000, "b" * 10))).first()
    assert (stats["n_chunks"], stats["n_pages"]) == (3, 2)
    assert (stats["min_length"], stats["max_length"]) == (10, 1000)
    assert stats["avg_length"] == pytest.approx((1000 + 200 + 10) / 3)
