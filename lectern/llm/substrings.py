"""Repeated passages: seeds from winnowed anchors, extended both ways, kept from 20 words on.

Of the 8-word runs inside a window of 20 words the one with the least hash is its anchor, so equal
windows have equal anchors at equal places. Neighbouring windows of one anchor form its *context*: the
seed with what may belong to a match on its left and right. Documents meet on anchors:

1. Count anchors. Only those that occur twice can be inside a repeat.
2. Contexts of such anchors that are equal as a whole are repeats without looking closer; the first keeps
   its words, all others lose them. One key is one context, so a passage of many copies is counted
   before it is shuffled.
3. Where one anchor has several contexts, matches end inside them: the windows of the first document
   of each context are compared one by one, which extends the seeds to exactly where they stop.

Scans two and three find their anchors by a filter of fixed size, and so send only what may match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import Spans, WordHashes, key_filter, mixed, passes, stored, text_slices, texts_of

WINDOW = 20
SEED = 8


class _Anchors:
    """Anchors of one text after the other, in one task."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed
        self.words, self.spans = WordHashes(), Spans()

    def read(self, text: bytes) -> bool:
        """Take a text; false if it has no window."""
        words = text.split()
        self.n = len(words)
        if self.n < self.window:
            return False
        self.sums = self.spans.sums(self.words.of(words))
        at = np.arange(self.n - self.seed + 1)
        seeds = self.spans.hashes(self.sums, at, at + self.seed)
        reach = self.window - self.seed + 1
        best = np.lib.stride_tricks.sliding_window_view(seeds, reach).argmin(axis=1)
        anchor = np.arange(len(best)) + best
        self.low = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        self.high = np.r_[self.low[1:] - 1, len(best) - 1]
        self.place = anchor[self.low]
        self.key = seeds[self.place]
        return True

    def contexts(self, at: np.ndarray) -> np.ndarray:
        low, high = self.low[at], self.high[at]
        shape = ((self.place[at] - low) * 64 + high - low).astype(np.uint64)
        return mixed(self.spans.hashes(self.sums, low, high + self.window) ^ mixed(shape + np.uint64(1)))

    def windows(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(self.low[at], self.high[at] + 1)
        return starts, self.spans.hashes(self.sums, starts, starts + self.window)


def _later(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def _arrow(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(v) if v and isinstance(v[0], np.ndarray) else v, kinds[k]) for k, v in columns.items()],
        list(columns),
    )


def _counted(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(window, seed)
        for batch in batches:
            for part in text_slices(batch):
                keys = [anchors.key.view(np.int64) for x in texts_of(part) if anchors.read(x)]
                if keys:
                    found, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["a", "n"])

    return docs.mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")


def _contexts(docs: DataFrame, wanted: np.ndarray, window: int, seed: int) -> DataFrame:
    """Contexts of wanted anchors: a, c, doc_id, low, high, later (met before in the document)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, kinds = _Anchors(window, seed), {"a": pa.int64(), "c": pa.int64(), "doc_id": pa.int64(), "low": pa.int32(), "high": pa.int32(), "later": pa.bool_()}
        for batch in batches:
            for part in text_slices(batch):
                out: dict[str, list] = {k: [] for k in kinds}
                for doc_id, text in zip(part.column(1).to_pylist(), texts_of(part), strict=True):
                    if doc_id is None or not anchors.read(text):
                        continue
                    at = np.flatnonzero(passes(shared.value, anchors.key))
                    if not len(at):
                        continue
                    contexts = anchors.contexts(at)
                    out["a"].append(anchors.key[at].view(np.int64))
                    out["c"].append(contexts.view(np.int64))
                    out["doc_id"].append(np.full(len(at), doc_id, np.int64))
                    out["low"].append(anchors.low[at].astype(np.int32))
                    out["high"].append(anchors.high[at].astype(np.int32))
                    out["later"].append(_later(contexts))
                if out["a"]:
                    yield _arrow(out, kinds)

    return docs.mapInArrow(run, "a bigint, c bigint, doc_id bigint, low int, high int, later boolean")


def _windows(docs: DataFrame, anchors_in: np.ndarray, docs_in: np.ndarray, window: int, seed: int) -> DataFrame:
    """Windows of anchors that have several contexts: a, c, doc_id, start, w (hashes)."""
    shared = docs.sparkSession.sparkContext.broadcast((anchors_in, docs_in))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(window, seed)
        wanted, holders = shared.value
        names = ["a", "c", "doc_id", "start", "w"]
        for batch in batches:
            for part in text_slices(batch):
                ids = part.column(1)
                rows: list[tuple] = []
                inside = passes(holders, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
                for k in np.flatnonzero(inside):
                    text = part.column(0)[k].as_py()
                    if not text or not ids[k].is_valid or not anchors.read(text.encode()):
                        continue
                    at = np.flatnonzero(passes(wanted, anchors.key))
                    contexts = anchors.contexts(at)
                    for i in np.flatnonzero(~_later(contexts)):
                        starts, hashes = anchors.windows(at[i])
                        rows.append((anchors.key[at[i]].astype(np.int64), contexts[i].astype(np.int64), ids[k].as_py(), int(starts[0]), hashes.view(np.int64)))
                if rows:
                    a, c, d, s, w = zip(*rows, strict=True)
                    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in w])].astype(np.int32), pa.array(np.concatenate(w)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(c)), pa.array(d, pa.int64()), pa.array(s, pa.int32()), lists], names)

    return docs.mapInArrow(run, "a bigint, c bigint, doc_id bigint, start int, w array<bigint>")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Stretches of words (doc_id, begin, end) covered by windows that also start earlier.

    Earlier means in a document of smaller id, or before in the same document. Ids are integers.
    Null texts and texts of fewer than ``window`` words have none. Documents without an id neither
    lose nor protect words. Rows that share an id are never earlier than each other.
    """
    narrow = docs.select(F.col(text).alias("text"), F.col(id).cast("bigint").alias("doc_id"))
    twice = stored(_counted(narrow, window, seed).select("a"), "anchors")
    found = stored(_contexts(narrow, key_filter(twice, "a"), window, seed), "contexts")
    firsts = stored(
        found.where("not later").groupBy("a", "c").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts"
    )
    end = (F.col("high") + F.lit(window)).alias("end")
    in_document = found.where("later").select("doc_id", F.col("low").alias("begin"), end)
    copies = (
        found.where("not later")
        .join(firsts.where("n > 1"), ["a", "c"])
        .where(F.col("doc_id") > F.col("first"))
        .select("doc_id", F.col("low").alias("begin"), end)
    )
    several = stored(firsts.groupBy("a").count().where("count > 1").select("a"), "several")
    edges = stored(firsts.join(several, "a").select("a", "c", "first"), "edges")
    single = _windows(narrow, key_filter(several, "a"), key_filter(edges.select("first"), "first"), window, seed)
    single = (
        single.join(edges, ["a", "c"])
        .where(F.col("doc_id") == F.col("first"))
        .select("a", "doc_id", "start", F.posexplode("w").alias("i", "w"))
        .groupBy("a", "w", "doc_id")
        .agg(F.min(F.col("start") + F.col("i")).alias("start"), F.sort_array(F.collect_set(F.col("start") + F.col("i"))).alias("all"))
    )
    single = stored(single, "windows")
    least = stored(single.groupBy("a", "w").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    extended = single.join(least, ["a", "w"]).where(F.col("doc_id") > F.col("first")).select("doc_id", F.explode("all").alias("begin"))
    again = single.where(F.size("all") > 1).select("doc_id", F.explode(F.slice("all", 2, 2**31 - 1)).alias("begin"))
    ends = [x.select("doc_id", "begin", (F.col("begin") + F.lit(window)).alias("end")) for x in (extended, again)]
    return in_document.unionByName(copies).unionByName(ends[0]).unionByName(ends[1])


def cut_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = True
) -> DataFrame:
    """One row per document: ``id``, n_words, n_removed, kept_sha256 and, ``with_text``, kept.

    ``kept`` are the words outside ``repeats``, joined by one space; the null text keeps the empty text.
    """
    spans = repeats(docs, id, text, window, seed).groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = stored(spans, "spans").withColumnRenamed("doc_id", "_doc")
    joined = docs.select(F.col(text).alias("text"), F.col(id).cast("bigint").alias("_id")).join(spans, F.col("_id") == F.col("_doc"), "left")
    schema = f"`{id}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for k, data in enumerate(texts_of(part)):
                    words = data.split()
                    spans = part.column(2)[k]
                    kept = words
                    if spans.is_valid:
                        inside = spans.values
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, inside.field("begin").to_numpy(zero_copy_only=False), 1)
                        np.add.at(change, np.minimum(inside.field("end").to_numpy(zero_copy_only=False), len(words)), -1)
                        gone = np.cumsum(change)[: len(words)] > 0
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    joined = b" ".join(kept)
                    row = [len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()]
                    rows.append([*row, joined.decode()] if with_text else row)
                columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
                names = [id, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names)

    return joined.select("text", "_id", "spans").mapInArrow(run, schema)
