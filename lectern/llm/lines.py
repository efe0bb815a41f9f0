"""Line dedup: lines that differ from an earlier line by one word at most are removed.

Lines are compared as sequences of words; a character of a script that is written without blanks is a
word of its own. Exact repeats go whatever their length; one edit is allowed in lines of ``min_words``
words or more, where such a character counts as half a word. The neighbourhood of a line is the line itself and all
variants with one word deleted; two lines within one edit share a variant, so equal hashed variants
are joined, the edit distance is verified on the words, and the earliest line is kept.

Two lines within one edit also share their first or their second half (both taken for the shorter of
the two lengths), so only lines of which a half occurs elsewhere can have a neighbour. Halves are
counted first, over distinct lines, and only lines that pass send variants, and only for the half in
which the edit must lie. This leaves out no pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import Spans, WordHashes, free_name, key_filter, mixed, passes, stored, text_slices, texts_of

MIN_WORDS = 5

# Thai, Lao, Burmese, Khmer, kana, Han; and bytes without which a line has none of them.
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MAY_BE_UNSPACED = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")

_U = np.uint64
_DELETED, _REPLACED = (int(mixed(np.array([k], np.uint64))[0]) for k in (14, 15))


def _words(line: bytes) -> tuple[list[bytes], int]:
    """The words of a line, and how many are characters of scripts without blanks."""
    if not _MAY_BE_UNSPACED.search(line):
        return line.split(), 0
    apart, n = _UNSPACED.subn(r" \g<0> ", line.decode())
    return apart.encode().split(), n


class _Lines:
    """Lines with a word of the texts of a slice, as parallel arrays; ``short`` ones have no halves."""

    def __init__(self, part: pa.RecordBatch, min_words: int):
        import xxhash

        digest = xxhash.xxh64_intdigest
        self.words: list[bytes] = []
        docs, numbers, later, short, hashes = [], [], [], [], []
        for row, (doc_id, text) in enumerate(zip(part.column(1).to_pylist(), texts_of(part), strict=True)):
            if doc_id is None:
                continue
            seen = set()
            for number, line in enumerate(text.split(b"\n")):
                words, unspaced = _words(line)
                n = len(words)
                if not n:
                    continue
                whole = b" ".join(words)
                key = digest(whole, 1)
                docs.append(row)
                numbers.append(number)
                later.append(key in seen)
                seen.add(key)
                self.words.append(whole)
                short.append(n < 2 or 2 * n - unspaced < 2 * min_words)
                if short[-1]:
                    hashes += (key, 0, 0, 0, 0)
                    continue
                # Halves for partners that are not shorter (m = n), and for shorter ones (m = n - 1).
                half, less = n // 2, (n - 1) // 2
                cut = len(b" ".join(words[:half]))
                first = cut if less == half else cut - 1 - len(words[half - 1])
                last = n - (n - 1 - less)
                rest = cut + 1 if last == half else cut + 2 + len(words[half])
                hashes += (
                    key,
                    digest(whole[:cut], 4 * n),
                    digest(whole[cut + 1 :], 4 * n + 1),
                    digest(whole[:first], 4 * n - 4),
                    digest(whole[rest:], 4 * n - 3),
                )
        table = np.array(hashes, np.uint64).reshape(-1, 5)
        self.key, self.halves = table[:, 0], [table[:, k] for k in range(1, 5)]
        rows = pa.array(docs, pa.int64())
        self.doc_id, self.digest = (part.column(c).take(rows).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
        self.line = np.array(numbers, np.int32)
        self.later, self.short = np.array(later, bool), np.array(short, bool)


def _all_lines(docs: DataFrame, min_words: int) -> DataFrame:
    names = ["doc_id", "d", "line", "h", "later", "k0", "k1", "k2", "k3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lines = _Lines(part, min_words)
                keys = [np.ascontiguousarray(k).view(np.int64) for k in (lines.key, *lines.halves)]
                columns = [pa.array(c) for c in (lines.doc_id, lines.digest, lines.line, keys[0], lines.later)]
                columns += [pa.array(k, mask=lines.short) for k in keys[1:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "doc_id bigint, d bigint, line int, h bigint, later boolean, k0 bigint, k1 bigint, k2 bigint, k3 bigint")


def _candidates(docs: DataFrame, wanted: np.ndarray, min_words: int) -> DataFrame:
    """Lines with a half that occurs elsewhere: h, doc_id, d, line, words, ``sides`` (which halves)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lines = _Lines(part, min_words)
                sides = np.zeros(len(lines.key), np.int32)
                for i, keys in enumerate(lines.halves):
                    sides |= passes(shared.value, keys).astype(np.int32) << i
                at = np.flatnonzero((sides > 0) & ~lines.later & ~lines.short)
                words = [lines.words[i].decode() for i in at]
                columns = [lines.key[at].view(np.int64), lines.doc_id[at], lines.digest[at], lines.line[at], words, sides[at]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "doc_id", "d", "line", "words", "sides"]
                )

    return docs.mapInArrow(run, "h bigint, doc_id bigint, d bigint, line int, words string, sides int")


def _variants(candidates: DataFrame) -> DataFrame:
    """Hashed variants: key, own (the line itself), h, doc_id, d, line.

    The line itself meets lines with one word more under the key of a deletion; lines with another
    word at the same place meet under the key of that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spans = WordHashes(), Spans()
        for batch in batches:
            out = []
            for i, (text, sides) in enumerate(zip(texts_of(batch, 4), batch.column(5).to_pylist(), strict=True)):
                sums = spans.sums(words.of(text.split()))
                n = len(sums) - 1
                keep = np.zeros(n, bool)
                for bit, m in ((0, n), (2, n - 1)):
                    if sides >> bit & 1:  # equal first halves: the edit is behind them
                        keep[m // 2 :] = True
                    if sides >> (bit + 1) & 1:  # equal second halves: it is before them
                        keep[: n - (m - m // 2)] = True
                p = np.flatnonzero(keep)
                with np.errstate(over="ignore"):
                    rest = mixed(sums[p] - sums[0] + (sums[n] - sums[p + 1]) * _U(Spans.INVERSE))
                    whole = mixed(sums[n:] - sums[0])
                    deleted = mixed(rest ^ mixed(np.array([n - 1], np.uint64)) ^ _U(_DELETED))
                    self_key = mixed(whole ^ mixed(np.array([n], np.uint64)) ^ _U(_DELETED))
                    replaced = mixed(rest ^ mixed((p + n * 2**24).astype(np.uint64)) ^ _U(_REPLACED))
                deleted = np.unique(deleted)
                keys = np.concatenate([self_key, deleted, replaced]).view(np.int64)
                own = np.zeros(len(keys), np.int8)
                own[0], own[1 : 1 + len(deleted)] = 1, 2
                out.append((np.full(len(keys), i, np.int64), keys, own))
            if out:
                row, keys, own = (np.concatenate(x) for x in zip(*out, strict=True))
                take = [batch.column(c).take(pa.array(row)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), *take], ["key", "own", "h", "doc_id", "d", "line"])

    return candidates.mapInArrow(run, "key bigint, own tinyint, h bigint, doc_id bigint, d bigint, line int")


def _one_edit(a: list[bytes], b: list[bytes]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_one_edit(x.split(), y.split()) for x, y in zip(texts_of(batch, 1), texts_of(batch, 2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in (0, 3, 4)], ["h", "before", "d"])

    return pairs.mapInArrow(run, "h bigint, before boolean, d bigint")


def removed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to remove (doc_id, ``d``: the text's xxhash64, line number from 0): an earlier line is at most
    one word edit away.

    Earlier is a smaller document id, or before in the same document. Lines of fewer than ``min_words``
    words go only if an earlier one has the same words; distances are judged on the input, not on what is
    left. Documents without an id neither lose lines nor remove others'; rows that share an id are not
    earlier than each other, whatever their texts (of several texts under one id, lines near to one of their own
    text go from the one of least ``d``). Ids are cast to bigint.
    """
    narrow = docs.select(F.col(text).alias("text"), F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("d"))
    lines = stored(_all_lines(narrow, min_words), "lines")
    halves = [f"k{i}" for i in range(4)]
    distinct = stored(
        lines.where("not later").groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in halves]),
        "distinct",
    )
    twice = distinct.select(F.explode(F.array_distinct(F.array(*halves))).alias("k")).where("k is not null").groupBy("k").count().where("count > 1")
    found = _candidates(narrow, key_filter(twice, "k"), min_words)
    firsts = distinct.select(F.col("h").alias("_h"), "first")
    found = found.join(firsts, (F.col("h") == F.col("_h")) & (F.col("doc_id") == F.col("first")))
    # Several texts of the first id may hold the line; the words are the same, the first place counts.
    at = F.min(F.struct("d", "line")).alias("at")
    candidates = found.groupBy("h").agg(F.min("doc_id").alias("doc_id"), at, F.min("words").alias("words"), F.max("sides").alias("sides"))
    candidates = stored(candidates.select("h", "doc_id", "at.d", "at.line", "words", "sides"), "candidates")
    variants = stored(_variants(candidates), "variants")
    place = F.struct("doc_id", "d", "line", "h")
    met = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("own") == 1, place)).alias("whole"),
        F.min(F.when(F.col("own") == 2, place)).alias("shorter"),
        F.min(F.when(F.col("own") == 0, place)).alias("same"),
    )
    met = stored(met.where("n > 1"), "met")
    keeper = F.when(F.col("own") == 1, F.col("shorter")).when(F.col("own") == 2, F.col("whole")).otherwise(F.col("same"))
    before = F.col("keeper.doc_id") < F.col("doc_id")
    earlier = (F.col("keeper") < place) & (before | (F.col("keeper.d") == F.col("d")))
    pairs = variants.join(met, "key").withColumn("keeper", keeper).where(earlier)
    pairs = pairs.select("h", F.col("keeper.h").alias("kept"), before.alias("before"), "d").distinct()
    texts = candidates.select("h", "words")
    pairs = pairs.join(texts, "h").join(texts.select(F.col("h").alias("kept"), F.col("words").alias("other")), "kept")
    near = _verified(pairs.select("h", "words", "other", "before", "d"))
    near = stored(near.groupBy("h").agg(F.max("before").alias("before"), F.max("d").alias("own")), "near")
    judged = distinct.select("h", "first", "n").join(near, "h", "left").where("n > 1 or own is not null")
    judged = stored(judged.select("h", "first", F.coalesce("before", F.lit(False)).alias("before"), "own"), "judged")
    gone = F.col("before") | (F.col("doc_id") > F.col("first")) | F.coalesce(F.col("d") == F.col("own"), F.lit(False))
    repeated = lines.where("not later").join(judged, "h").where(gone)
    return lines.where("later").select("doc_id", "d", "line").unionByName(repeated.select("doc_id", "d", "line"))


def cut_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that are kept, and n_lines, n_removed, kept_sha256.

    A null text stays null and has no lines, an empty text one. Each row loses what ``removed_lines`` finds for
    its id and text, so repeated rows lose the same, and rows that share an id each their own; a null id loses
    nothing, and an empty table gives an empty one. Other columns stay; columns with the names of the three
    added ones are replaced.
    """
    gone = removed_lines(docs, id, text, min_words).groupBy("doc_id", "d").agg(F.collect_set("line").alias("_gone"))
    key, digest, dead_lines = free_name(docs, "_doc"), free_name(docs, "_digest"), free_name(docs, "_gone")
    gone = stored(gone, "gone").toDF(key, digest, dead_lines)
    # Always by sort and merge, so that the cost grows evenly with the input.
    same = (F.col(id).cast("bigint") == F.col(key)) & (F.xxhash64(text) == F.col(digest))
    joined = docs.drop("n_lines", "n_removed", "kept_sha256").join(gone.hint("merge"), same, "left").drop(key, digest)
    columns = [c for c in joined.columns if c != dead_lines]
    at = columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(columns).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column=at):
                texts, counts = [], []
                for data, dead in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                    if data is None:
                        texts.append(None)
                        counts.append((0, 0, hashlib.sha256(b"").hexdigest()))
                        continue
                    lines, dead = data.split(b"\n"), set(dead or ())
                    kept = b"\n".join(x for i, x in enumerate(lines) if i not in dead)
                    texts.append(kept.decode())
                    counts.append((len(lines), sum(i < len(lines) for i in dead), hashlib.sha256(kept).hexdigest()))
                arrays = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(columns))]
                arrays += [pa.array(list(c)) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_lines", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"{schema}, n_lines bigint, n_removed bigint, kept_sha256 string")
