"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores, per shard of whole documents, the postings of every word: the ascending
positions at which it stands. Positions have a gap between documents, so a phrase never spans two. What
only Python reads is packed into one binary value per shard, of which the JVM holds a few at a time.
``search`` takes the test items in blocks of bounded size to all shards. For each run of 13 words it
starts from the postings of the word that is rarest in the shard, shifts them by the place of the word in
the run, and keeps what the next rarer words' shifted postings also have: what is left is the exact
matches. Proximity matches are stretches of a document, as long as the item, that hold all but one of the
item's rarest words; how rare a word is, the documents of the whole index tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.tasks import blocks, stored, text_slices, texts_of

WINDOW = 13
SHARD_BYTES = 2 * 2**20
# Rows of the stored index that are written or read at once; a shard takes about half its text.
GROUP_BYTES = 4 * 2**20
# Rarest words of an item that proximity looks for; one of them may be missing if there are three or more.
NEAR_TERMS = 5
# What one block of test items may weigh; more items are searched in several blocks.
BLOCK_BYTES = 16 * 2**20

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

# ``terms``: packed columns term, n_docs, n_postings; ``postings``: of all terms in turn, packed steps from one to the next.
_SHARD_COLUMNS = ["shard", "doc_ids", "n_words", "terms", "postings"]
_SHARD_KINDS = "n_words array<int>, terms binary, postings binary"


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


def _packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> list[pa.Array]:
    with pa.ipc.open_stream(value.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)) as stream:
        return stream.read_next_batch().columns


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _shard(doc_ids: pa.Array, texts: list[bytes], name: str) -> pa.RecordBatch:
    numbers = _Numbers()
    counts, ids = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    terms = np.concatenate(ids) if ids else np.empty(0, np.int32)
    gaps = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    order = np.argsort(terms, kind="stable")
    postings = (np.arange(len(terms), dtype=np.int32) + gaps)[order]
    sizes = np.bincount(terms, minlength=len(numbers)).astype(np.int32)
    docs, sorted_terms = gaps[order], terms[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (sorted_terms[1:] != sorted_terms[:-1])] if len(terms) else np.empty(0, bool)
    n_docs = np.bincount(sorted_terms[new], minlength=len(numbers)).astype(np.int32)
    known = _packed({"term": pa.array(list(numbers), pa.binary()), "n_docs": pa.array(n_docs), "n_postings": pa.array(sizes)})
    steps = _packed({"step": pa.array(np.diff(postings, prepend=np.int32(0)))})
    lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (doc_ids, pa.array(counts, pa.int32()))]
    packed = [pa.array([x], pa.binary()) for x in (known, steps)]
    return pa.RecordBatch.from_arrays([pa.array([name]), *lists, *packed], _SHARD_COLUMNS)


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a stored table, one row per shard of at most ``shard_bytes`` of whole texts (a longer
    text is a shard of its own). Null ids and repeated ids are kept as places of their own, null texts have
    no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, shard_bytes):
                yield _shard(part.column(1), texts_of(part), f"{task}-{made}")
                made += 1

    narrow = docs.select(F.col(text).alias("text"), F.col(id).alias("doc_id"))
    kind = docs.schema[id].dataType.simpleString()
    made = narrow.mapInArrow(run, f"shard string, doc_ids array<{kind}>, {_SHARD_KINDS}")
    return stored(made, "postings", group_bytes=GROUP_BYTES)


class _Queries:
    """Test items of one block: windows as rows of term numbers, and the terms that proximity looks for."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.terms: dict[bytes, int] = {}
        by_width: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.whole: list[tuple[int, set[int], int]] = []
        self.near: list[tuple[int, np.ndarray, int]] = []
        for item, text in items:
            words = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            if not words:
                continue
            width = min(WINDOW, len(words))
            rows = by_width.setdefault(width, {})
            for i in range(len(words) - width + 1):
                rows.setdefault(tuple(words[i : i + width]), set()).add(item)
            self.whole.append((item, set(words), len(words)))
        self.windows = [
            (width, np.array(list(rows), np.int64), [sorted(x) for x in rows.values()])
            for width, rows in sorted(by_width.items())
        ]

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(list(self.terms), pa.binary())

    def choose(self, n_docs: dict[int, int], near_terms: int) -> None:
        """Of each item's terms that occur at all, the rarest, equal ones by their letters."""
        words = {number: word for word, number in self.terms.items()}
        for item, distinct, reach in self.whole:
            rarest = sorted((t for t in distinct if t in n_docs), key=lambda t: (n_docs[t], words[t]))[:near_terms]
            if len(rarest) > 1:
                self.near.append((item, np.array(rarest, np.int64), reach))


def _needed(terms: int) -> int:
    """How many of an item's rarest terms a stretch must hold."""
    return terms - (terms > 2)


def _holds(postings: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(postings, wanted)
    at[at == len(postings)] = 0
    return postings[at] == wanted


def _known(queries: _Queries, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the block that a shard has: their numbers in the block and in the shard."""
    numbers = pa.compute.index_in(terms, value_set=queries.words)
    found = pa.compute.is_valid(numbers).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(found)
    return numbers.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64), at


def _search_shard(queries: _Queries, terms: pa.Array, sizes: np.ndarray, postings: np.ndarray, ends: np.ndarray):
    """Exact matches (item, begin, end) and proximity matches (item, begin, end) in positions.

    ``ends``: the position behind the last word of each document."""
    begins = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.zeros(len(queries.terms), np.int64)
    places = np.zeros(len(queries.terms), np.int64)
    known, at = _known(queries, terms)
    counts[known], places[known] = sizes[at], begins[at]

    def listed(term: int) -> np.ndarray:
        return postings[places[term] : places[term] + counts[term]]

    exact, near = [], []
    for width, rows, items in queries.windows:
        frequencies = counts[rows]
        for k in np.flatnonzero(frequencies.min(axis=1) > 0):
            row, rarest = rows[k], np.argsort(frequencies[k], kind="stable")
            found = listed(row[rarest[0]]) - rarest[0]
            for j in rarest[1:]:
                if not len(found):
                    break
                found = found[_holds(listed(row[j]), found + j)]
            exact += [(item, int(at), int(at) + width) for at in found for item in items[k]]
    for item, terms_, reach in queries.near:
        held = terms_[counts[terms_] > 0]
        if len(held) < _needed(len(terms_)):
            continue
        lists = [listed(t).astype(np.int64) for t in held]
        at = np.sort(np.concatenate(lists))
        room = np.minimum(at + reach, ends[np.searchsorted(ends, at, "right")])  # where stretch or document ends
        found, last = np.zeros(len(at), np.int64), at.copy()
        for other in lists:
            follows = np.searchsorted(other, at)
            next_ = other[np.minimum(follows, len(other) - 1)]
            inside = (follows < len(other)) & (next_ < room)
            found += inside
            last = np.where(inside, np.maximum(last, next_), last)
        keep = found >= _needed(len(terms_))
        near += [(item, int(a), int(b) + 1) for a, b in zip(at[keep], last[keep], strict=True)]
    return exact, near


def _frequencies(index: DataFrame, queries: _Queries) -> dict[int, int]:
    """Documents of the whole index that hold each term of the block; a row for each of its terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, n_docs, _ = _unpacked(batch.column(0)[i])
                known, place = _known(queries, terms)
                sums[known] += n_docs.to_numpy()[place]  # a shard has each term once
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["term", "n"])

    parts = index.select("terms").mapInArrow(run, "term int, n bigint")
    return {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def search(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    near_terms: int = NEAR_TERMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Matches: shard, place (of the document in the shard), doc_id, item_id, kind, begin, end (words).

    ``kind`` is 'exact': a stretch of the document covered by windows of the item, or 'near': a stretch no
    longer than the item that holds all but one (of two: both) of its ``near_terms`` rarest words; rarest by the
    documents of the whole index, among words that occur in it at all. ``near_terms=0`` leaves these out. Items
    without words match nothing; items of fewer than 13 words are one window. Repeated
    items and rows give repeated matches of equal content once per item id; null item ids are left out.
    """
    named = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    named = named.where(F.col("id").isNotNull())
    spark, found = index.sparkSession, None
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = to_arrow_type(index.schema["doc_ids"].dataType.elementType)
    schema = f"shard string, place int, doc_id {kind}, item_id bigint, kind string, begin int, end int"
    names = ["shard", "place", "doc_id", "item_id", "kind", "begin", "end"]
    for block in blocks(named, block_bytes):
        asked = _Queries(block)
        if near_terms:
            asked.choose(_frequencies(index, asked), near_terms)
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    name, doc_ids, counts, known, steps = (batch.column(c)[i] for c in _SHARD_COLUMNS)
                    terms, _, sizes = _unpacked(known)
                    postings = np.cumsum(_unpacked(steps)[0].to_numpy(), dtype=np.int32)
                    counts = counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    starts = np.cumsum(counts + 1) - counts - 1
                    exact, near = _search_shard(queries, terms, sizes.to_numpy(), postings, starts + counts)
                    ids, rows = doc_ids.as_py(), []
                    for kind, hits in (("exact", exact), ("near", near)):
                        open_at: dict[tuple[int, int], list[int]] = {}
                        for item, begin, end in sorted(set(hits)):
                            place = int(np.searchsorted(starts, begin, "right")) - 1
                            span = open_at.get((item, place))
                            if span is not None and begin <= span[6]:
                                span[6] = max(span[6], end)
                                continue
                            span = [name.as_py(), place, ids[place], item, kind, begin, end]
                            open_at[item, place] = span
                            rows.append(span)
                    if rows:
                        columns = [list(x) for x in zip(*rows, strict=True)]
                        moved = starts[np.array(columns[1])]
                        columns[5] = np.array(columns[5]) - moved
                        columns[6] = np.array(columns[6]) - moved
                        kinds = [pa.string(), pa.int32(), id_type, pa.int64(), pa.string(), pa.int32(), pa.int32()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                        )

        part = index.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def documents_hit(index: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per document: shard, place, doc_id, n_words, n_hit, item_ids, n_near.

    ``n_hit`` counts the words inside exact matches, ``item_ids`` lists their items as sorted strings,
    ``n_near`` counts items with proximity matches only. Documents without matches have 0 and no items.
    """
    spans = F.array_sort(F.collect_set(F.when(F.col("kind") == "exact", F.struct("begin", "end"))))
    exact = F.collect_set(F.when(F.col("kind") == "exact", F.col("item_id").cast("string")))
    near = F.collect_set(F.when(F.col("kind") == "near", F.col("item_id").cast("string")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    hits = matches.groupBy("shard", "place").agg(spans.alias("spans"), exact.alias("exact"), near.alias("near"))
    hits = hits.select(
        "shard",
        "place",
        covered.cast("bigint").alias("_hit"),
        F.array_sort("exact").alias("_items"),
        F.size(F.array_except("near", "exact")).cast("bigint").alias("_near"),
    )
    docs = index.select(
        "shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")
    ).select("shard", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("bigint").alias("n_words"))
    empty = F.array().cast("array<string>")
    return docs.join(hits, ["shard", "place"], "left").select(
        "shard",
        "place",
        "doc_id",
        "n_words",
        F.coalesce("_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("_items", empty).alias("item_ids"),
        F.coalesce("_near", F.lit(0).cast("bigint")).alias("n_near"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    near_terms: int = NEAR_TERMS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Index the documents, search the items, and judge: ``documents_hit`` plus ``contaminated``.

    A document is contaminated if at least a twentieth of its words are inside exact matches; proximity
    matches are only counted. Documents without words (null and empty texts too) are clean. Repeated rows are
    judged each, null ids are kept; an empty table of documents gives an empty one, one of items judges all
    clean. Other columns are not read.
    """
    index = build_index(docs, id, text, shard_bytes)
    judged = documents_hit(index, search(index, items, near_terms=near_terms))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
