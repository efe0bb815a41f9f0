"""Ranked lexical search on a length-stratified index.

Documents of equal normaliser ``m`` (a function of their length) form a stratum; a row of the index is a part of
one stratum with its postings ordered by term and then by falling term frequency. Within a row, all that a
posting adds to a score depends on term and frequency alone, so it is worked out once per frequency, and the
greatest frequency of each term bounds what any document of the row can reach for an item.

A search sends items in blocks of bounded size to the rows. The rows with the highest bounds of each
item are visited first; the k-th best score found there is a threshold that no result can lie below. Then every
row is visited for the items whose bound there reaches the threshold, and hands on documents that reach it.
Scores are sums of whole numbers, so neither the order of visits nor the layout of the index changes them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tasks import blocks, stored, text_slices, texts_of

TOP = 10
# Text behind one row of the index; a longer text has a row of its own.
ROW_BYTES = 4 * 2**20
# What one block of items may weigh.
BLOCK_BYTES = 2**20
# Rows of the index that set an item's threshold.
VISITS = 4

_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOWERED = bytes((c + 32 if 65 <= c <= 90 else c) if _WORD[c] else 32 for c in range(256))
_PIECE = 2**20

INDEX_SCHEMA = (
    "name string, m bigint, doc_ids array<bigint>, terms array<binary>, df array<int>, most array<int>, "
    "n_groups array<int>, tfs array<int>, sizes array<int>, places array<int>"
)


@dataclass
class Index:
    """The stored rows, the number of documents with a term, and the number of their terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _count(text: bytes) -> int:
    inside = _WORD[np.frombuffer(text, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1])) if len(inside) else 0


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about a megabyte."""
    plain, begin = text.translate(_LOWERED), 0
    while begin < len(plain):
        end = plain.find(b" ", begin + _PIECE) if len(plain) - begin > _PIECE else -1
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def _lengths(docs: DataFrame) -> DataFrame:
    """doc_id, text and n (number of terms) of the documents that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column=1):
                n = np.array([_count(x) for x in texts_of(part, 1)], np.int64)
                made = pa.RecordBatch.from_arrays([*part.columns, pa.array(n)], ["doc_id", "text", "n"])
                yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id bigint, text string, n bigint")


def _row(name: str, m: int, doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
    numbers = _Numbers()
    terms, tfs, places = [], [], []
    for place, text in enumerate(texts):
        pieces = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in terms_of(text)]
        found, counts = np.unique(np.concatenate(pieces), return_counts=True)
        terms.append(found)
        tfs.append(counts.astype(np.int32))
        places.append(np.full(len(found), place, np.int32))
    terms, tfs, places = np.concatenate(terms), np.concatenate(tfs), np.concatenate(places)
    order = np.lexsort((places, -tfs, terms))
    terms, tfs, places = terms[order], tfs[order], places[order]
    new_term = np.r_[True, terms[1:] != terms[:-1]]
    new_group = new_term | np.r_[True, tfs[1:] != tfs[:-1]]
    begins = np.flatnonzero(new_group)
    sizes = np.diff(np.r_[begins, len(terms)]).astype(np.int32)
    first = np.flatnonzero(new_term)
    df = np.diff(np.r_[first, len(terms)]).astype(np.int32)
    n_groups = np.bincount(terms[begins], minlength=len(numbers)).astype(np.int32)
    lists = [doc_ids, list(numbers), df, tfs[first], n_groups, tfs[begins], sizes, places]
    kinds = [pa.int64(), pa.binary(), *[pa.int32()] * 6]
    made = [pa.ListArray.from_arrays([0, len(x)], pa.array(x, k)) for x, k in zip(lists, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([m], pa.int64()), *made],
        ["name", "m", "doc_ids", "terms", "df", "most", "n_groups", "tfs", "sizes", "places"],
    )


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES) -> Index:
    """The index of all documents with a term, as a stored table.

    Lengths are counted first, as the normaliser needs the number of documents and of their terms. A stratum is cut
    into parts of about ``row_bytes`` of text, its documents dealt out evenly, so a stratum of most rows is shared out.
    """
    narrow = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    weight = F.octet_length("text").cast("bigint")
    lengths = stored(_lengths(narrow).groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum(weight).alias("bytes")), "lengths")
    found = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n")).alias("terms")).first()
    n_docs, n_terms = found["docs"] or 0, found["terms"] or 0
    m = F.expr(f"10 + (90L * n * {n_docs}L) div {max(1, n_terms)}L")
    parts = F.ceil(F.sum("bytes") / row_bytes).cast("bigint")
    # One row per stratum that is cut; Spark broadcasts it if its file is small enough.
    cut = stored(lengths.groupBy(m.alias("_m")).agg(parts.alias("parts")).where("parts > 1"), "strata")
    rows = _lengths(narrow).select("doc_id", "text", m.alias("m"), F.monotonically_increasing_id().alias("at"))
    rows = rows.join(cut, F.col("m") == F.col("_m"), "left")
    rows = rows.select("m", F.coalesce(F.col("at") % F.col("parts"), F.lit(0)).alias("part"), "doc_id", "text")
    rows = rows.repartition("m", "part").sortWithinPartitions("m", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, ids, texts, held = None, 0, [], [], 0
        for batch in (part for whole in batches for part in text_slices(whole, column=3)):
            for m, part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(3)), texts_of(batch, 3), strict=True):
                if (m, part) != key or held + len(text) > row_bytes:
                    if ids:
                        yield _row(f"{key[0]}-{key[1]}-{piece}", key[0], ids, texts)
                    piece = piece + 1 if (m, part) == key else 0
                    key, ids, texts, held = (m, part), [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield _row(f"{key[0]}-{key[1]}-{piece}", key[0], ids, texts)

    return Index(stored(rows.mapInArrow(run, INDEX_SCHEMA), "index"), n_docs, n_terms)


class _Items:
    """A block of items: numbered terms, and pairs of item and term."""

    def __init__(self, block: list[tuple]):
        by_id: dict = {}
        for item, text in block:
            by_id.setdefault(item, set()).update(t for words in terms_of(text) for t in words)
        self.ids = list(by_id)
        self.terms: dict[bytes, int] = {}
        self.of_item = [np.array(sorted(self.terms.setdefault(t, len(self.terms)) for t in found), np.int64) for found in by_id.values()]
        self.pair_term = np.concatenate([np.empty(0, np.int64), *self.of_item])
        self.pair_item = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.of_item])
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        for term, n in df.items():
            self.weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def met(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the block that a row has: their numbers in the block and in the row."""
        known = self.terms
        found = [(known[t], i) for i, t in enumerate(terms) if t in known]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def bounds(self, own: np.ndarray, most: np.ndarray, m: int) -> np.ndarray:
        """What a document can reach for each item at most."""
        best = np.zeros(len(self.terms), np.int64)
        best[own] = self.weights[own] * _share(most.astype(np.int64), m)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.pair_item, best[self.pair_term])
        return out


def _share(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _best(ids: list, score: np.ndarray, least: int, k: int) -> list[tuple]:
    """The ``k`` best (doc_id, score) of at least ``least``; equal scores by ascending id, null last."""
    at = np.flatnonzero(score >= max(1, least))
    if len(at) > k:
        kth = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= kth]
    found = [(ids[i], int(score[i])) for i in at]
    return sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]


def _visit(items: _Items, wanted: np.ndarray, least: np.ndarray, batch: pa.RecordBatch, i: int, own, local, m: int, k: int) -> list[tuple]:
    """The best documents of a row for the wanted items: (item number, doc_id, score)."""
    doc_ids = batch.column("doc_ids")[i].as_py()
    n_groups, tfs, sizes, places = (_numbers(batch.column(c), i) for c in ("n_groups", "tfs", "sizes", "places"))
    group = np.concatenate([[0], np.cumsum(n_groups, dtype=np.int64)])
    posting = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    where = dict(zip(own.tolist(), local.tolist(), strict=True))
    added: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for item in wanted.tolist():
        score = np.zeros(len(doc_ids), np.int64)
        for term in items.of_item[item].tolist():
            if term not in where:
                continue
            if term not in added:
                a, b = group[where[term]], group[where[term] + 1]
                impact = items.weights[term] * _share(tfs[a:b].astype(np.int64), m)  # once per frequency
                added[term] = places[posting[a] : posting[b]], np.repeat(impact, sizes[a:b])
            at, impact = added[term]
            score[at] += impact
        out += [(item, *x) for x in _best(doc_ids, score, int(least[item]), k)]
    return out


_FOUND = "item int, doc_id bigint, score bigint"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = [pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "doc_id", "score"])


def _frequencies(index: Index, items: _Items) -> dict[int, int]:
    """Documents that hold each term of the block; as many rows as the block has terms at most."""
    terms = index.rows.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                df = _numbers(batch.column(1), i)
                found = [(terms.value[t], j) for j, t in enumerate(batch.column(0)[i].as_py()) if t in terms.value]
                if found:
                    own, local = np.array(found).T
                    sums[own] += df[local]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["term", "df"])

    parts = index.rows.select("terms", "df").mapInArrow(run, "term int, df bigint")
    found = {r["term"]: r["df"] for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    terms.unpersist()
    return found


def _thresholds(index: Index, items: _Items, shared, k: int, visits: int) -> np.ndarray:
    """For each item the k-th best score in the rows with its highest bounds; 0 where fewer were found."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = shared.value, []
        for batch in batches:
            for i in range(batch.num_rows):
                own, local = block.met(batch.column(2)[i].as_py())
                if len(own):
                    bounds = block.bounds(own, _numbers(batch.column(3), i)[local], batch.column(1)[i].as_py())
                    name = batch.column(0)[i].as_py()
                    rows += [(int(j), int(bounds[j]), name) for j in np.flatnonzero(bounds)]
            if rows:
                order = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
                rows = [r for n, r in enumerate(order) if n < visits or order[n - visits][0] != r[0]]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = [pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "bound", "name"])

    bounds = index.rows.select("name", "m", "terms", "most").mapInArrow(bound, "item int, bound bigint, name string")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "name")
    first = bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= visits).select("item", "name")
    by_name: dict[str, list[int]] = {}
    for r in first.collect():  # ``visits`` rows for each item of the block
        by_name.setdefault(r["name"], []).append(r["item"])
    least = np.zeros(len(items.ids), np.int64)
    if not by_name:
        return least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = np.array(sorted(by_name[batch.column("name")[i].as_py()]))
                own, local = block.met(batch.column("terms")[i].as_py())
                yield _found(_visit(block, wanted, np.zeros(len(block.ids), np.int64), batch, i, own, local, batch.column("m")[i].as_py(), k))

    best = index.rows.where(F.col("name").isin(list(by_name))).mapInArrow(run, _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("item", "score")
    for r in best.collect():  # one row for each item of the block at most
        least[r["item"]] = r["score"]
    return least


def search(
    index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP, visits: int = VISITS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    Rows of ``items`` that share an id (null is one too) are one item with the terms of all of them; terms count
    once. Items without a known term have no rows. Equal scores come by ascending doc_id, null last.
    """
    spark = index.rows.sparkSession
    found = None
    for block in blocks(items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")), block_bytes):
        own = _Items(block)
        own.weigh(_frequencies(index, own), index.n_docs)
        shared = spark.sparkContext.broadcast(own)
        least = _thresholds(index, own, shared, k, visits)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, least=least) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    m = batch.column("m")[i].as_py()
                    own, local = block.met(batch.column("terms")[i].as_py())
                    if not len(own):
                        continue
                    bounds = block.bounds(own, _numbers(batch.column("most"), i)[local], m)
                    wanted = np.flatnonzero((bounds > 0) & (bounds >= least))
                    rows = _visit(block, wanted, least, batch, i, own, local, m, k)
                    columns = _found(rows)
                    ids = pa.array([block.ids[r[0]] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *columns.columns[1:]], ["item_id", "doc_id", "score"])

        part = index.rows.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """Index the documents and search the items: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. Documents without a term (null
    and empty texts too) are not counted. Repeated rows are documents of their own and may take several ranks,
    null ids are kept; an empty table on either side gives an empty one. Other columns are not read.
    """
    return search(build_index(docs, id, text), items, item_id, item_text, k)
