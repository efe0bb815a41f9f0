"""Language ID by interpolated Kneser-Ney models of four characters, one per language.

Characters are folded to 16 bits (lower case, one code for all that is not a letter or mark), so that a
4-gram is a 64-bit number. Spark counts the 4-grams of each language over all training texts and from
them the types that continue each shorter gram. Grams are exact keys throughout, so that the tables grow
with the types seen. Joins of these tables give each 4-gram of the corpus its bits in every language, in
whole units of 2**-24 bit, so that sums do not depend on their order. The most frequent grams go to the
tasks as sorted arrays of at most ``head`` bytes; where there are more, the others are counted per
document and joined with their bits. A text gets the language whose model has
the lowest cross-entropy per character. Texts that no model explains are rejected: their excess over the
mean cross-entropy of the language, weighed by length, lies beyond the quantile that training texts of
the language exceed with probability ``alpha``, and is larger than ``margin`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import stored, text_slices

ORDER = 4
HEAD_BYTES = 64 * 2**20
ALPHA = 0.0005
MARGIN_BITS = 2.5
SLICE = 2**20
UNIT = 2**24
UNKNOWN = "und"

_U = np.uint64
_TABLE_END = 0x33000


class _Codes:
    """Texts as arrays of 16-bit codes, made in one task."""

    def __init__(self):
        import unicodedata

        self.code = np.full(_TABLE_END + 1, 32, np.uint64)
        self.letter = np.zeros(_TABLE_END + 1, bool)
        for c in range(_TABLE_END):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                low = chr(c).lower()
                low = ord(low) if len(low) == 1 else c
                self.code[c] = low if low < 65536 else 0xE000 + low % 0x1900
                self.letter[c] = kind == "L"

    def of(self, text: str | None) -> np.ndarray | None:
        """4-grams of a text, one for each of its characters; None without a letter."""
        if not text:
            return None
        points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _TABLE_END)
        if not self.letter[points].any():
            return None
        codes = self.code[points]
        blank = codes == 32
        codes = codes[~(blank & np.r_[True, blank[:-1]])]
        c = np.concatenate([np.full(3, 32, _U), codes, np.full(int(codes[-1] != 32), 32, _U)])
        return c[:-3] << _U(48) | c[1:-2] << _U(32) | c[2:-1] << _U(16) | c[3:]


def _counts(docs: DataFrame) -> DataFrame:
    """``lang`` (null too), ``g`` (4-gram as bigint) and its count ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for part in text_slices(batch, SLICE):
                grams: dict[str | None, list[np.ndarray]] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = codes.of(text)
                    if found is not None:
                        grams.setdefault(lang, []).append(found)
                for lang, lists in grams.items():
                    counts = pd.Series(np.concatenate(lists)).value_counts(sort=False)
                    keys = counts.index.to_numpy().astype(np.uint64).view(np.int64)
                    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.to_numpy(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "g", "c"])

    return docs.mapInArrow(run, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _suffix(g: Column, n: int) -> Column:
    """The last ``n`` characters of grams."""
    return g if n == ORDER else g.bitwiseAND(F.lit((1 << (16 * n)) - 1))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], DataFrame]:
    """The languages in ``lang`` by name; each 4-gram ``g`` of all texts, its count ``n`` and ``bits``:
    -log2 P(last character | three before it) of each language in units of 2**-24.

    Rows without a language or a letter teach nothing.
    """
    every = stored(_counts(docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))), "grams")
    by_order = {ORDER: every.where(F.col("lang").isNotNull())}
    names = sorted(r["lang"] for r in by_order[ORDER].select("lang").distinct().collect())
    for n in range(ORDER - 1, 0, -1):
        suffix = _suffix(F.col("g"), n).alias("g")
        by_order[n] = stored(by_order[n + 1].groupBy("lang", suffix).agg(F.count(F.lit(1)).alias("c")), "grams")
    grams = stored(every.groupBy("g").agg(F.sum("c").alias("n")), "grams")
    languages = F.array(*[F.lit(name) for name in names]).cast("array<string>")
    below = None
    for n in range(1, ORDER + 1):
        own = by_order[n]
        ones, twos = (F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2))
        seldom = {r["lang"]: (r["n1"], r["n2"]) for r in own.groupBy("lang").agg(ones, twos).collect()}
        discounts = [min(0.95, max(0.1, seldom[name][0] / (seldom[name][0] + 2 * seldom[name][1]))) if seldom[name][0] else 0.5 for name in names]
        discounts = F.array(*[F.lit(d) for d in discounts]).cast("array<double>")
        counts = own.groupBy(F.col("g").alias(f"_g{n}")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("count"))
        context = F.shiftrightunsigned("g", 16) if n > 1 else F.lit(0).cast("bigint")
        totals = own.groupBy("lang", context.alias("_context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
        totals = totals.groupBy("_context").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("total", "types").alias("t")))).alias("t"))
        keys = grams if n == ORDER else grams.select(_suffix(F.col("g"), n).alias("g")).distinct()
        context = F.shiftrightunsigned("g", 16) if n > 1 else F.lit(0).cast("bigint")
        keys = keys.withColumn("context", context)
        keys = keys.join(counts, F.col("g") == F.col(f"_g{n}"), "left")
        keys = keys.join(F.broadcast(totals) if n == 1 else totals, F.col("context") == F.col("_context"), "left")
        if below is None:
            keys = keys.withColumn("p", F.transform(languages, lambda x: F.lit(1 / 65536)))
        else:
            keys = keys.join(below, _suffix(F.col("g"), n - 1) == F.col("_below"))

        def smoothed(p: Column, i: Column) -> Column:
            name, d = F.get(languages, i), F.get(discounts, i)
            count, t = F.coalesce(F.try_element_at("count", name), F.lit(0)), F.try_element_at("t", name)
            return F.when(t["total"] > 0, (F.greatest(count - d, F.lit(0.0)) + d * t["types"] * p) / t["total"]).otherwise(p)

        p = F.transform("p", smoothed)
        if n < ORDER:
            below = keys.select(F.col("g").alias("_below"), p.alias("p"))
    bits = F.transform(p, lambda x: F.round(-F.log2(x) * UNIT).cast("bigint"))
    return names, stored(keys.select("g", "n", bits.alias("bits")), "bits")


def _head(bits: DataFrame, languages: int, limit: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The most frequent grams in order and their bits (a row per language); the others, if there are any.

    Counts are cut at a power of two, so that all but 64 rows stay in Spark until the head is known.
    """
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["count"] for r in bits.groupBy(level.alias("level")).count().collect()}
    held, least = 0, 64
    for k in sorted(sizes, reverse=True):
        held += sizes[k] * 8 * (1 + languages)
        if held > limit:
            break
        least = k
    table = bits.where(level >= least).select("g", "bits").toArrow().combine_chunks()
    keys = table["g"].to_numpy()
    order = np.argsort(keys)
    values = np.zeros((0, languages), np.int64)
    if len(keys):
        values = pa.compute.list_flatten(table["bits"]).to_numpy().reshape(-1, languages)
    rest = bits.where(level < least) if any(k < least for k in sizes) else None
    return keys[order], np.ascontiguousarray(values[order].T), rest


def _scores(docs: DataFrame, names: list[str], bits: DataFrame, carried: list[str], limit: int) -> DataFrame:
    """Carried columns, then lang_pred, score, cross_entropy, n (characters)."""
    head, values, rest = _head(bits, len(names), limit) if names else (np.empty(0, np.int64), np.empty((0, 0), np.int64), None)
    shared = docs.sparkSession.sparkContext.broadcast((head, values))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    told = [*carried, "lang_pred", "score", "cross_entropy", "n"]
    final = f"{schema}, lang_pred string, score double, cross_entropy double, n bigint"
    at_once = rest is None  # all grams are in the head, so tasks can judge without a join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        head, values = shared.value
        for batch in batches:
            for part in text_slices(batch, SLICE):
                grams = [codes.of(x) for x in part.column(0).to_pylist()]
                rows = [i for i, g in enumerate(grams) if g is not None and names]
                size = np.zeros(len(grams), np.int64)
                sums = np.zeros((len(grams), len(names)), np.int64)
                others, counts = [[] for _ in grams], [[] for _ in grams]
                if rows:
                    sizes = np.array([len(grams[i]) for i in rows])
                    place, distinct = pd.factorize(np.concatenate([grams[i] for i in rows]))
                    distinct = distinct.view(np.int64)
                    known, at = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
                    if len(head):
                        at = np.minimum(np.searchsorted(head, distinct), len(head) - 1)
                        known = head[at] == distinct
                    begins = np.cumsum(sizes) - sizes
                    for k in range(len(names)):
                        own = np.where(known, values[k][at], 0) if len(head) else np.zeros(len(distinct), np.int64)
                        sums[rows, k] = np.add.reduceat(own[place], begins)
                    size[rows] = sizes
                    if not at_once:
                        for i, begin, n in zip(rows, begins, sizes, strict=True):
                            own = place[begin : begin + n]
                            found, count = np.unique(own[~known[own]], return_counts=True)
                            others[i], counts[i] = distinct[found], count
                if at_once:
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *_chosen_language(names, size, sums)], told)
                    continue
                lists = pa.list_(pa.int64())
                columns = [pa.array(size), *(pa.array(list(x), lists) for x in (sums, others, counts))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*carried, "n", "sums", "grams", "counts"])

    if rest is None:
        return docs.mapInArrow(run, final)
    parts = docs.mapInArrow(run, f"{schema}, n bigint, sums array<bigint>, grams array<bigint>, counts array<bigint>")
    parts = stored(parts.withColumn("_row", F.monotonically_increasing_id()), "parts")
    each = parts.select("_row", F.explode(F.arrays_zip("grams", "counts")).alias("x")).select("_row", "x.*")
    each = each.join(rest.select(F.col("g").alias("grams"), "bits"), "grams")
    added = F.array(*[F.sum(F.col("bits")[k] * F.col("counts")) for k in range(len(names))])
    added = each.groupBy(F.col("_row").alias("_own")).agg(added.alias("added"))
    sums = F.when(F.col("added").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "added", lambda a, b: a + b))
    parts = parts.join(added, F.col("_row") == F.col("_own"), "left").withColumn("sums", sums)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(len(carried)).to_numpy()
            sums = np.array(batch.column(len(carried) + 1).to_pylist(), np.int64).reshape(len(size), len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *_chosen_language(names, size, sums)], told)

    return parts.select(*carried, "n", "sums").mapInArrow(choose, final)


def _chosen_language(names: list[str], size: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, cross_entropy, n from the summed bits of each document and language."""
    best, bits, score = np.full(len(size), -1), np.zeros(len(size)), np.zeros(len(size))
    rows = np.flatnonzero(size)
    if len(rows):
        entropy = sums[rows].T / (size[rows] * float(UNIT))
        best[rows], least = entropy.argmin(axis=0), entropy.min(axis=0)
        bits[rows] = least
        score[rows] = 1 / np.exp2(-(entropy - least) * np.sqrt(size[rows])).sum(axis=0)
    labels = [names[b] if b >= 0 else UNKNOWN for b in best]
    return [pa.array(labels, pa.string()), pa.array(score), pa.array(bits), pa.array(size)]


def identify(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    learn: Column | None = None,
    alpha: float = ALPHA,
    margin: float = MARGIN_BITS,
    head: int = HEAD_BYTES,
) -> DataFrame:
    """One row per document: ``id``, lang_pred, score, cross_entropy (bits per character), rejected.

    Learns from the rows that fulfil ``learn`` (default: all) and have a language. ``lang_pred`` is the
    best language, or ``und`` for null texts, texts without a letter, and if nothing was learned; those
    have score 0 and are rejected. Equal cross-entropies go to the first language by name. ``score``
    falls with the distance of the others. ``head`` does not change results. Repeated rows and null ids are kept; other columns are not read.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(
        F.col(text).alias("text"), F.col(id).alias("id"), F.when(learn, F.col(lang).cast("string")).alias("taught")
    )
    names, bits = train(rows, "text", "taught")
    scored = stored(_scores(rows, names, bits, ["id", "taught"], head), "languages")
    own = scored.where((F.col("taught") == F.col("lang_pred")) & (F.col("n") > 0))
    mean = own.groupBy("lang_pred").agg((F.sum(F.col("n") * F.col("cross_entropy")) / F.sum("n")).alias("mean"))
    mean = stored(mean, "means")
    excess = (F.col("cross_entropy") - F.col("mean")) * F.sqrt("n")
    limit = own.join(F.broadcast(mean), "lang_pred").groupBy("lang_pred").agg(
        F.first("mean").alias("mean"), F.percentile_approx(excess, 1 - alpha, 10_000).alias("limit")
    )
    limit = F.broadcast(stored(limit, "limits"))  # a row per language
    beyond = (excess > F.col("limit")) & (F.col("cross_entropy") - F.col("mean") > margin)
    return scored.join(limit, "lang_pred", "left").select(
        F.col("id").alias(id),
        "lang_pred",
        "score",
        "cross_entropy",
        (F.coalesce(beyond, F.lit(False)) | (F.col("lang_pred") == UNKNOWN)).alias("rejected"),
    )
