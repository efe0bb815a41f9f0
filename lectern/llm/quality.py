"""Quality rules whose cutoffs are chosen under a bound on false rejections, in SQL functions only.

Each rule rejects texts whose measure lies above a cutoff. The cutoffs of all rules tighten together along one
nested path of STEPS, from lenient to strict, so that a text has a first step at which any rule rejects it.
Labelled documents are the holdout: at a step, let n be the good documents of a stratum and k those that are
rejected there. The step is safe if k or fewer rejections out of n would be unlikely, exactly by the binomial
distribution, were the true rate ``alpha``. Steps are tested in order until one fails (a fixed sequence needs no
further correction), and each stratum is tested at level ``delta`` divided by the number of strata
(Bonferroni). So with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents.

Texts that are equal are one trial, as copies say nothing new. Strata whose good documents are too few for any
step to pass are tested together, as one stratum more; the bound then holds for them as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import stored

BLANK = " \t\n\x0b\x0c\r"
ALPHA = 0.02
DELTA = 0.05
REPEAT = 5

# The path of cutoffs from lenient to strict, in hundredths of words (symbols, repeated words, characters
# of a word) or lines.
STEPS = {
    "symbols": [200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5],
    "repeats": [20, 20, 20, 19, 18, 17, 16, 15, 13, 11, 8],
    "lines": [90, 80, 75, 70, 65, 60, 55, 50, 40, 30, 20],
    "long_words": [3000, 2500, 2200, 2000, 1800, 1700, 1600, 1500, 1400, 1300, 1200],
}
N_STEPS = len(STEPS["symbols"])

_SHIFT = 28  # bits for a place in the text; the rest of a packed number is the head of a hash


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t\n\x0B\f\r]+")).otherwise(none)


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Counts are of the whole text, row by row, without a shuffle. Null texts count zero.

    Words inside repeated windows are found by sorting: each window's hash is packed with its place, and
    neighbours of equal head are candidates; among those few, whole 64-bit hashes decide.
    """
    width = REPEAT
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.select(*keep, "_text", _words(F.col("_text")).alias("_words"), F.split("_text", "\n", -1).alias("_all"))
    rows = rows.withColumn("_lines", F.filter("_all", lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0))
    size = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(width)])
    hashes = F.when(size >= width, F.transform(F.sequence(F.lit(0), size - width), window))
    rows = rows.select(
        *keep,
        size.cast("bigint").alias("n_words"),
        F.length(F.translate("_text", BLANK, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_hashes"),
    )
    head = lambda x: F.shiftright(x, _SHIFT)
    packed = F.transform("_hashes", lambda x, i: F.shiftleft(head(x), _SHIFT).bitwiseOR(i.cast("bigint")))
    rows = rows.withColumn("_sorted", F.sort_array(packed))
    beside = lambda x, i: (head(x) == head(F.get("_sorted", i - 1))) | (head(x) == head(F.get("_sorted", i + 1)))
    rows = rows.withColumn("_near", F.filter("_sorted", beside))
    place = lambda x: x.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")
    pair = lambda x: F.struct(F.get("_hashes", place(x)).alias("h"), place(x).alias("p"))
    rows = rows.withColumn("_pairs", F.array_sort(F.transform("_near", pair)))
    equal = lambda x, i: (x["h"] == F.get("_pairs", i - 1)["h"]) | (x["h"] == F.get("_pairs", i + 1)["h"])
    rows = rows.withColumn("_places", F.sort_array(F.transform(F.filter("_pairs", equal), lambda x: x["p"])))
    covered = lambda x, i: F.least(F.lit(width), F.coalesce(F.get("_places", i + 1) - x, F.lit(width)))
    rows = rows.withColumn("_covered", F.transform("_places", covered))
    total = F.aggregate("_covered", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", total.alias("n_repeat_words")
    )


def _ratios() -> dict[str, Column]:
    hundred = lambda a, b: F.coalesce(F.try_divide(100 * F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbols": hundred("n_symbols", "n_words"),
        "repeats": hundred("n_repeat_words", "n_words"),
        "lines": hundred("n_dup_lines", "n_lines"),
        "long_words": hundred("word_chars", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, summed term by term in logarithms; at most k + 1 terms."""
    first = n * F.lit(math.log(1 - p))
    state = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.ln((n - i + 1) / i) + F.lit(math.log(p / (1 - p)))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, state, add, lambda s: s["sum"])


def first_rejected() -> Column:
    """The first step at which a rule rejects a measured text; N_STEPS if none does."""
    ratios = _ratios()
    each = []
    for rule, cutoffs in STEPS.items():
        step = F.lit(N_STEPS)
        for i, cutoff in reversed(list(enumerate(cutoffs))):
            step = F.when(ratios[rule] > cutoff, F.lit(i)).otherwise(step)
        each.append(step)
    return F.least(*each)


def least_trials(alpha: float, level: float) -> int:
    """Good documents that a stratum needs for a step without any rejection to pass."""
    return math.ceil(math.log(level) / math.log(1 - alpha))


def safe_steps(measured: DataFrame, good: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, step: the last safe step of every stratum that has one (from 0), tested in order.

    ``measured`` has ``stratum``, ``digest`` of the text, the measures, and ``good``, true for the good documents of the
    holdout. At most a row for each stratum and step is left after the first aggregation.
    """
    trials = measured.where(good).select("stratum", "digest", first_rejected().alias("at")).groupBy("stratum", "digest").agg(F.min("at").alias("at"))
    counted = stored(trials.groupBy("stratum", "at").agg(F.count(F.lit(1)).alias("n")), "counted")
    strata = counted.groupBy("stratum").agg(F.sum("n").alias("size"))
    level = delta / (strata.count() + 1)
    few = F.col("size") < least_trials(alpha, level)
    strata = strata.select(F.col("stratum").alias("own"), F.when(few, F.lit(None)).otherwise(F.col("stratum")).alias("tested"))
    sums = counted.join(strata, F.col("stratum") == F.col("own")).groupBy("tested", "at").agg(F.sum("n").alias("n"))
    sizes = sums.groupBy(F.col("tested").alias("_t")).agg(F.sum("n").alias("size"))
    steps = sizes.select("_t", "size", F.explode(F.sequence(F.lit(0), F.lit(N_STEPS - 1))).alias("step"))
    met = steps.join(sums, F.col("_t").eqNullSafe(F.col("tested")) & (F.col("at") <= F.col("step")), "left")
    tests = met.groupBy("_t", "size", "step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))
    # Beyond the expected number of rejections the tail is far above any level, so no sum is needed.
    tail = F.when(F.col("k") <= F.col("size") * alpha, binomial_tail(F.col("size"), F.col("k"), alpha)).otherwise(1.0)
    failed = F.min(F.when(tail > level, F.col("step")))
    last = tests.groupBy("_t").agg((F.coalesce(failed, F.lit(N_STEPS)) - 1).alias("step")).where("step >= 0")
    return strata.join(last, F.col("tested").eqNullSafe(F.col("_t"))).select(F.col("own").alias("stratum"), "step")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """``measures`` per document with stratum, digest, first_step (that rejects it), safe_step (of its stratum, null
    if none), base_failed and kept.

    ``labels`` has ``id`` and ``label`` (1 good, 0 not); a document is good if all its labels are 1.
    Documents without a stratum form one of their own. Repeated rows and ids are judged each, null ids
    have no label. Null and empty texts have no words and fail the base rules. Strata without good documents, and
    all without labels, have no safe step, and only the base rules decide; an empty table gives an empty one.
    """
    base = docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"),
        F.col(text).alias("text"),
    )
    measured = stored(measures(base, ["id", "stratum", "digest"]), "measures")
    truth = labels.groupBy(F.col(id).alias("id")).agg((F.min(F.coalesce(F.col(label), F.lit(0))) == 1).alias("good"))
    chosen = safe_steps(measured.join(stored(truth, "truth"), "id"), "good", alpha, delta)
    chosen = stored(chosen.select("stratum", F.col("step").alias("safe_step")), "steps")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measured.join(chosen, "stratum", "left")
        .withColumn("first_step", first_rejected())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("first_step") > F.coalesce("safe_step", F.lit(-1))))
        .withColumnRenamed("id", id)
    )
