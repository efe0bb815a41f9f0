"""From text to vectors: a model the caller supplies, or hashed token counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_WIDTH = 384

VECTOR = T.ArrayType(T.FloatType())

# Bytes of text, and texts, whose tokens are held at a time.
_STRETCH, _STRETCH_ROWS = 1 << 20, 2048


def embed(
    df: DataFrame,
    make_predict_fn: Callable,
    text: str = "content",
    output: str = "embedding",
    batch_size: int = 256,
) -> DataFrame:
    """Add ``output``: the model's vector for ``text``.

    ``make_predict_fn()`` loads the model and returns a function from a batch of texts to a
    matrix with one row per text. It runs once per Python worker, not once per batch.

    Filter before embedding: the optimizer treats the model as if it had side effects, which
    keeps it from running the model once more for a filter or an explode further up, but also
    keeps it from moving such a filter below.
    """
    model = predict_batch_udf(make_predict_fn, return_type=VECTOR, batch_size=batch_size)
    return df.withColumn(output, model.asNondeterministic()(F.col(text)))


def _stretches(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows of about ``_STRETCH`` bytes, or of a single longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(int(np.searchsorted(ends, before + _STRETCH, "right")), begin + _STRETCH_ROWS))
        yield begin, end
        begin = end


def _token_vectors(dim: int) -> Callable[[pa.Array], pa.Array]:
    def scaled(text: pa.Array) -> np.ndarray:
        rows = len(text)
        pieces = pc.split_pattern_regex(pc.fill_null(text, ""), r"[^\p{L}\p{N}]+")
        owner = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        # One digest per distinct token of the stretch; everything else is array arithmetic.
        tokens = coded.dictionary.cast(pa.binary()).to_pylist()
        digests = np.frombuffer(b"".join(md5(token).digest() for token in tokens), dtype=">u4")
        bucket = (digests[::4] % dim).astype(np.int64)
        bucket[[i for i, token in enumerate(tokens) if not token]] = -1
        bucket = bucket[coded.indices.to_numpy(zero_copy_only=False)]
        real = bucket >= 0
        cells = owner[real].astype(np.int64) * dim + bucket[real]
        counts = np.bincount(cells, minlength=rows * dim).reshape(rows, dim)
        length = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
        length[length == 0] = 1.0
        return counts / length[:, None]

    def vectors(text: pa.Array) -> pa.Array:
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        # Tokens take many times the room of their text, so a batch is worked off in stretches.
        flat = np.empty((len(text), dim), np.float32)
        for begin, end in _stretches(text):
            flat[begin:end] = scaled(text.slice(begin, end - begin))
        offsets = np.arange(0, (len(text) + 1) * dim, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return vectors


def hash_embed(
    df: DataFrame, dim: int = EMBEDDING_WIDTH, text: str = "content", output: str = "embedding"
) -> DataFrame:
    """Add ``output``: token counts hashed into ``dim`` buckets, scaled to length one.

    Needs no model and no network. Tokens are runs of letters and digits in lower case; the
    bucket is the first 32 bits of the token's MD5 modulo ``dim``. Text without tokens gives
    the zero vector. Works batch by batch inside the scan stage: no shuffle. As with ``embed``,
    filter before.
    """
    vectors = F.arrow_udf(_token_vectors(dim), VECTOR).asNondeterministic()
    return df.withColumn(output, vectors(F.lower(F.col(text))))
