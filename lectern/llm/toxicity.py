"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark whole documents, so tokens are labelled first: a token of a toxic document is toxic if its
word, or its first letters, occur in toxic documents far more often than in others, beyond what chance
gives. A field with two states is then fitted by gradient ascent on the conditional likelihood; features are
the word and its beginnings, hashed to a fixed number of weights, and the transitions. Chains are sentences,
cut after CHAIN tokens. Forward-backward gives each token its marginal; the expected number and share
of toxic tokens and the largest marginal go through a logistic curve fitted on documents that the field has not seen.

Fitting uses a bounded sample of labelled documents: ``sample`` toxic and as many others, the least hashes of
their ids, of each class ``sample_bytes`` of text at most. Half of it teaches the field, the other half the curve;
of the field's chains without a toxic token one in ``other_chains`` is learned from. The sample is small and
sits on the driver. Scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tasks import stored, text_slices

SAMPLE = 2000
SAMPLE_BYTES = 12 * 2**20
OTHER_CHAINS = 4
CHAIN = 64
WEIGHT_BITS = 18
ROUNDS = 40
SPAN_MARGINAL = 0.5

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


def _features(word: str) -> list[int]:
    import xxhash

    pieces = [word, *[f"{n}^{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n]]
    return [xxhash.xxh64_intdigest(p.encode(), 3) >> (64 - WEIGHT_BITS) for p in pieces]


def _keys(word: str) -> list[str]:
    return [word, *[f"{n}^{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n]]


class _Shared(dict):
    """One string object per word, as the sample holds each word many times."""

    def __missing__(self, word: str) -> str:
        self[word] = word
        return word


def _places(text: str, low: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the lower-cased text as code points of the text; some characters grow when lowered."""
    if len(low) == len(text):
        return spans
    ends = np.cumsum([len(c.lower()) for c in text])
    return [(int(np.searchsorted(ends, b, "right")), int(np.searchsorted(ends, e - 1, "right")) + 1) for b, e in spans]


def _chains(tokens: list[str]) -> list[tuple[int, int]]:
    """Begin and end of each chain of words among ``tokens``."""
    out, begin = [], 0
    for i, token in enumerate([*tokens, "."]):
        if token in _STOPS or i - begin >= CHAIN:
            if i > begin:
                out.append((begin, i))
            begin = i + (token in _STOPS)
    return out


def _messages(e: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of chains, steps by chains; lengths fall. ``a``: transitions [from, to]."""
    steps, x, y = len(e), np.zeros_like(e), np.zeros_like(e)
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # chains longer than t
    x[0] = e[0] + a[0, 1] - a[0, 0]
    for t in range(1, steps):
        m = active[t]
        p = x[t - 1, :m]
        x[t, :m] = e[t, :m] + np.logaddexp(p + a[1, 1], a[0, 1]) - np.logaddexp(p + a[1, 0], a[0, 0])
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        n = e[t + 1, :m] + y[t + 1, :m]
        y[t, :m] = np.logaddexp(a[1, 1] + n, a[1, 0]) - np.logaddexp(a[0, 1] + n, a[0, 0])
    return x, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _laid_out(chains: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers as steps by chains (-1 where there is none), lengths, and the mask."""
    begins = np.array([c[0] for c in chains], np.int64)
    lengths = np.array([c[1] - c[0] for c in chains], np.int64)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    at = np.arange(lengths[0])[:, None]
    mask = at < lengths[None, :]
    return np.where(mask, begins[None, :] + at, -1), lengths, mask


def _labels(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words and beginnings that mark toxic documents."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for tokens, label in zip(texts, toxic, strict=True):
        counts[int(label)].update({k for w in set(tokens) - _STOPS for k in _keys(w)})
    n_toxic, n_other = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marks = set()
    for key, k in counts[1].items():
        rate, other = k / n_toxic, (counts[0][key] + 0.5) / n_other
        spread = np.sqrt(other * (1 - min(1.0, other)) / n_toxic) + 1e-9
        if k >= 5 and rate > 3 * other and rate - other > 5 * spread:
            marks.add(key)
    return marks


def _statistics(p: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Document features from token marginals; ``begins`` of documents of at least one token."""
    sizes = np.diff(np.r_[begins, len(p)])
    expected = np.add.reduceat(p, begins)
    largest = np.maximum.reduceat(p, begins)
    return np.column_stack([np.ones(len(begins)), np.log1p(expected), largest, 20 * expected / (sizes + 20)])


def _fit_field(texts: list[list[str]], toxic: np.ndarray, rounds: int, other_chains: int) -> dict:
    marks = _labels(texts, toxic)
    tokens = [t for x in texts for t in [*x, "\n"]]
    mine = np.repeat(toxic, [len(x) + 1 for x in texts])
    known = {w: _features(w) for w in set(tokens) - _STOPS}
    marked = {w: any(k in marks for k in _keys(w)) for w in known}
    label = np.array([m and marked.get(t, False) for t, m in zip(tokens, mine, strict=True)])
    chains = [c for c in _chains(tokens)]
    weights, a = np.zeros(2**WEIGHT_BITS), np.zeros((2, 2))
    model = {"weights": weights, "transitions": a}
    if not chains or not label.any():
        model["bias"] = -8.0
        return model
    held = np.add.reduceat(label, np.array([c[0] for c in chains]))
    wanted = [c for i, c in enumerate(chains) if held[i] or i % other_chains == 0]
    place, lengths, mask = _laid_out(wanted)
    width = max(map(len, known.values()))
    row = {w: [*f, *[2**WEIGHT_BITS] * (width - len(f))] for w, f in known.items()}
    inside = place[mask]
    features = np.fromiter((f for i in inside for f in row[tokens[i]]), np.int32, width * len(inside)).reshape(-1, width)
    truth = label[inside].astype(float)
    del tokens, row, known
    bias, scale, steps = -3.0, np.full(2**WEIGHT_BITS + 1, 1e-6), np.full((2, 2), 1e-6)
    w = np.zeros(2**WEIGHT_BITS + 1)
    grid = np.zeros(place.shape)
    follows = mask[1:]
    y = np.zeros(place.shape)
    y[mask] = truth
    bias_scale = 1e-6
    for _ in range(rounds):
        grid[mask] = sum(w[features[:, k]] for k in range(width)) + bias
        x, back = _messages(grid, lengths, a)
        p = _sigmoid(x + back)
        error = truth - p[mask]
        gradient = -0.01 * w
        for k in range(width):
            gradient += np.bincount(features[:, k], error, minlength=len(w))
        gradient[-1] = 0
        scale += gradient**2
        w += 0.5 * gradient / np.sqrt(scale)
        total = error.sum()
        bias_scale += total**2
        bias += 0.3 * total / np.sqrt(bias_scale)
        onward = grid[1:] + back[1:]
        logits = [i * x[:-1] + a[i, j] + j * onward for i in (0, 1) for j in (0, 1)]
        norm = np.logaddexp.reduce(logits)
        for n, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            seen = ((y[:-1] == i) & (y[1:] == j) & follows).sum()
            g = seen - np.exp(logits[n] - norm)[follows].sum() - 0.01 * a[i, j]
            steps[i, j] += g**2
            a[i, j] += 0.2 * g / np.sqrt(steps[i, j])
    model.update(weights=w[:-1].astype(np.float32), transitions=a, bias=float(bias))
    return model


class _Emissions(dict):
    """Log-odds of words, remembered up to a bound; stops have none."""

    LIMIT = 500_000

    def __init__(self, model: dict):
        super().__init__()
        self.weights, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = 0.0 if word in _STOPS else float(self.weights[_features(word)].sum()) + self.bias
        self[word] = value
        return value


def _marginals(texts: list[list[str]], emissions: _Emissions, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens (0 for stops) and the begin of each text among them; texts end in a stop."""
    tokens = [t for x in texts for t in (*x, "\n")]
    e = np.fromiter(map(emissions.__getitem__, tokens), float, len(tokens))
    p = np.zeros(len(tokens))
    chains = _chains(tokens)
    if chains:
        place, lengths, mask = _laid_out(chains)
        grid = np.where(mask, e[place], 0.0)
        x, y = _messages(grid, lengths, a)
        p[place[mask]] = _sigmoid(x + y)[mask]
    sizes = np.array([len(x) + 1 for x in texts])
    return p, np.cumsum(sizes) - sizes


def _fit_curve(features: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Logistic regression by Newton steps, weighed so that toxic rows have the natural rate."""
    share = max(1e-6, toxic.mean())
    weight = np.where(toxic, rate / share, (1 - rate) / max(1e-6, 1 - share))
    b = np.zeros(features.shape[1])
    for _ in range(30):
        p = _sigmoid(features @ b)
        gradient = features.T @ (weight * (toxic - p)) - 0.1 * b
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(b))
        b = b + np.linalg.solve(hessian, gradient)
    return b


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> list:
    """Rows text, toxic of the documents to learn from, in a fixed order; bounded in number and bytes.

    Equal texts are one, toxic if any of their labels says so.
    """
    order = F.xxhash64("id")
    chosen = [labels.where(F.col("toxic") == t).orderBy(order, "id").limit(sample) for t in (True, False)]
    picked = F.broadcast(stored(chosen[0].unionByName(chosen[1]), "picked"))  # 2 * sample rows at most
    met = docs.join(picked, "id").where(F.length("text") > 0)
    place = F.struct(F.xxhash64("id").alias("hash"), "id", "text")
    texts = met.groupBy(F.md5("text").alias("digest")).agg(F.max("toxic").alias("toxic"), F.min(place).alias("place"))
    texts = stored(texts.select("toxic", "place.hash", "place.id", "place.text", "digest"), "sample")
    so_far = Window.partitionBy("toxic").orderBy("hash", "id", "digest")
    held = texts.select("toxic", "digest", F.octet_length("text").alias("n"), "hash", "id")
    held = held.withColumn("bytes", F.sum("n").over(so_far)).withColumn("rows", F.row_number().over(so_far))
    held = held.where((F.col("bytes") <= sample_bytes) & (F.col("rows") <= sample)).select("digest")
    return sorted(texts.join(F.broadcast(held), "digest").select("id", "text", "toxic").collect(), key=lambda r: (str(r["id"]), r["text"]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    sample_bytes: int = SAMPLE_BYTES,
    other_chains: int = OTHER_CHAINS,
) -> dict:
    """Fit field and curve. ``docs``: id, text; ``labels``: id and ``toxic`` (boolean), one row per id.

    The driver holds ``sample`` documents and ``sample_bytes`` of text of either class at most.
    """
    labels = stored(labels.where(F.col("toxic").isNotNull() & F.col("id").isNotNull()), "labels")
    count = labels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("k")).first()
    rows = _sample(docs, labels, sample, sample_bytes)
    shared = _Shared()
    texts = [list(map(shared.__getitem__, _TOKEN.findall(r["text"].lower()))) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], bool)
    first = np.arange(len(rows)) % 2 == 0
    del rows
    model = _fit_field([x for x, f in zip(texts, first, strict=True) if f], toxic[first], rounds, other_chains)
    rate = (count["k"] + 0.5) / (count["n"] + 1)
    rest = [x for x, f in zip(texts, first, strict=True) if not f]
    model["curve"] = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
    if rest and 0 < toxic[~first].sum() < len(rest):
        p, begins = _marginals(rest, _Emissions(model), model["transitions"])
        model["curve"] = _fit_curve(_statistics(p, begins), toxic[~first], rate)
    return model


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """``id``, score (0 to 1) and, ``with_spans``, spans: begin and end (code points) of tokens whose
    marginal is at least SPAN_MARGINAL. Null and empty texts get the score of a text without toxic tokens."""
    kind = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id}` {kind}, score double" + (", spans array<struct<begin:int,end:int>>" if with_spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        emissions = _Emissions(fitted)
        for batch in batches:
            for part in text_slices(batch):
                texts = [x or "" for x in part.column(0).to_pylist()]
                tokens = [_TOKEN.findall(x.lower()) for x in texts]
                p, begins = _marginals(tokens, emissions, fitted["transitions"])
                columns = [part.column(1), pa.array(_sigmoid(_statistics(p, begins) @ fitted["curve"]))]
                if with_spans:
                    found, hot = [], np.append(np.flatnonzero(p >= SPAN_MARGINAL), len(p))
                    for k, text in enumerate(texts):
                        own = hot[np.searchsorted(hot, begins[k]) : np.searchsorted(hot, begins[k] + len(tokens[k]))] - begins[k]
                        wanted = set(own.tolist())
                        low = text.lower() if wanted else ""
                        spans = [m.span() for i, m in enumerate(_TOKEN.finditer(low)) if i in wanted]
                        spans = _places(text, low, spans) if spans else []
                        found.append([{"begin": b, "end": e} for b, e in spans])
                    columns.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, [id, "score", *(["spans"] if with_spans else [])])

    return docs.select(text, id).mapInArrow(run, schema)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    learn: Column | None = None,
    sample: int = SAMPLE,
    with_spans: bool = True,
) -> DataFrame:
    """Learn from labelled rows of ``labels`` that fulfil ``learn`` (a condition on its columns), score all.

    Of several labels of a document, or of documents with the same text, the worst counts; null labels and null
    ids teach nothing. Without labels, or with labels of one class only, all scores are the same. Null and empty
    texts get the score of a text without toxic tokens. Repeated rows are scored each; an empty table gives an
    empty one; other columns are not read.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    truth = labels.where(learn).groupBy(F.col(id).alias("id")).agg((F.max(F.col(label)) == 1).alias("toxic"))
    model = train(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), truth, sample)
    return score(docs, model, id, text, with_spans)
