"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the bytes cuts texts into chunks; equal passages get equal chunks wherever
they stand, and a chunk that was met before in the task is not encoded again. A cut may fall inside
a word, so every join of two chunks is repaired: the stretch from the last safe place before the cut
to the first one after it is encoded anew, and the ids of the chunks are kept up to those places. A
place is safe if it stands before a single space between two visible ASCII characters, since words
are split there whatever stands further left or right. The repaired ids agree exactly with those
of the whole text when both chunks have a token boundary at the place; otherwise, or if a chunk has
no safe place, the stretch grows over the neighbouring chunks, at last over the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.tasks import text_slices, texts_of

SPECIAL = "<|endoftext|>"

CHUNK_BITS = 10
CACHE_BYTES = 48 * 2**20

# From here on (U+0250) Unicode tables of libraries of different age may name other letters, so
# that such chunks are left to the library whose results count.
_OTHER_LEAD = 0xC9


def _cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Places after which the last 16 bytes hash to zero in ``bits`` bits, at whole characters."""
    if len(data) < 32:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        factor = 0xD6E8FEB86659FD93
        for reach in (1, 2, 4, 8):
            h = h[reach:] * np.uint64(factor) + h[:-reach]
            factor = factor * factor % 2**64
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + 16
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def _safe(data: np.ndarray) -> np.ndarray:
    """Places before a single space between visible ASCII characters."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    visible = (data > 0x20) & (data < 0x7F)
    return np.flatnonzero(visible[:-2] & (data[1:-1] == 0x20) & visible[2:]) + 1


class ChunkEncoder:
    """Encodes and decodes texts in one task. ``ranks`` and ``whole`` are two files of one vocabulary."""

    def __init__(self, ranks: str, whole: str, pattern: str, bits: int = CHUNK_BITS, held: int = CACHE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = Tokenizer.from_file(whole)
        self.library.no_truncation()
        self.library.no_padding()
        last = self.library.token_to_id(SPECIAL)
        special = {} if last is None else {SPECIAL: last}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        tokens = [b""] * (max([*table.values(), *special.values()]) + 1)
        for word, rank in table.items():
            tokens[rank] = word
        for word, rank in special.items():
            tokens[rank] = word.encode()
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.bits, self.held = bits, held
        self.cache: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.weight = self.encoded = self.reused = 0

    def _fresh(self, piece: bytes) -> np.ndarray:
        text = piece.decode()
        if text.isascii() or max(piece) < _OTHER_LEAD:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
            except Exception:  # the fast library gives up on some very long runs; the other does not
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def chunk(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte at which each ends."""
        known = self.cache.get(piece)
        if known is not None:
            self.reused += 1
            return known
        self.encoded += 1
        ids = self._fresh(piece)
        known = ids, np.cumsum(self.lengths[ids])
        if self.weight > self.held:
            self.cache.clear()
            self.weight = 0
        self.cache[piece] = known
        self.weight += 300 + len(piece) + 12 * len(ids)
        return known

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of the whole text."""
        if not text:
            return np.empty(0, np.uint32)
        data = np.frombuffer(text, np.uint8)
        bounds = [0, *_cuts(data, self.bits).tolist(), len(text)]
        if len(bounds) == 2:
            return self.chunk(text)[0]
        safe = _safe(data)
        out, done, last = [], 0, len(bounds) - 2
        first_safe = np.searchsorted(safe, bounds, "right").tolist()
        end_safe = np.searchsorted(safe, bounds, "left").tolist()
        for k in range(last + 1):
            begin, end = bounds[k], bounds[k + 1]
            low = 0 if k == 0 else int(safe[first_safe[k]]) if first_safe[k] < end_safe[k + 1] else None
            high = end if k == last else int(safe[end_safe[k + 1] - 1]) if first_safe[k] < end_safe[k + 1] else None
            if low is None or high is None or high <= low:
                continue  # no safe place, so the stretch that is encoded anew grows over this chunk
            ids, ends = self.chunk(text[begin:end])
            a = 0 if low == begin else int(np.searchsorted(ends, low - begin)) + 1
            b = len(ids) if high == end else int(np.searchsorted(ends, high - begin)) + 1
            agree = (a == 0 or (a <= len(ids) and ends[a - 1] == low - begin)) and (b > 0 and b <= len(ids) and ends[b - 1] == high - begin)
            if not agree:
                continue
            if low > done:
                out.append(self._fresh(text[done:low]))
            out.append(ids[a:b])
            done = high
        if done < len(text):
            out.append(self._fresh(text[done:]))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text as UTF-8; bytes that are no character become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        moved = np.repeat(self.starts[ids] - ends + lengths, lengths)
        joined = self.flat[moved + np.arange(len(moved))].tobytes()
        return joined.decode("utf-8", "replace").encode()


def encode(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    *,
    ranks: str,
    whole: str,
    pattern: str,
    with_values: bool = True,
) -> DataFrame:
    """One row per document: ``id``, n_tokens, ids, ids_sha256, decoded, decoded_sha256.

    ``ranks`` and ``whole`` are the rank file and the library's own file of one vocabulary, at a path
    that exists on every executor; ``pattern`` splits words. With ``with_values`` false, ids and
    decoded are left out, so that only digests leave the tasks. The work is one pass over the scan,
    without a shuffle; the reuse of chunks is per task and bounded by CACHE_BYTES.

    A null or empty text has no tokens and decodes to an empty text. Repeated rows and repeated or null
    ids are kept as they come; other columns are not read. The string of the special token counts as
    that token, as in the library.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_values:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(ranks, whole, pattern)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for data in texts_of(part):
                    ids = encoder.encode(data)
                    back = encoder.decode(ids)
                    row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()]
                    rows.append([*row, ids.astype(np.int32), back.decode()] if with_values else row)
                columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_values else [])]
                if with_values:
                    columns[3] = columns[3].cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], [id, *names])

    return docs.select(text, id).mapInArrow(run, schema)


def decode(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", *, ranks: str, whole: str, pattern: str) -> DataFrame:
    """Ids back to texts: ``id``, decoded. Null ids give an empty text; an unknown id fails the job."""
    kind = tokens.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(ranks, whole, pattern)
        for batch in batches:
            texts = [encoder.decode(np.asarray(v or [], np.int64)).decode() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], [id, "decoded"])

    return tokens.select(ids, id).mapInArrow(run, f"`{id}` {kind}, decoded string")
