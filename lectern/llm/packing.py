"""Lexical retrieval packing: windows of tokens filled with documents that read alike.

Documents are tokenised in the scan and gathered into shards of bounded size, each with a BM25 inverted index
over its tokens. The first unused document of a shard is a seed: its tokens query the index, and the unused
neighbours that come back fill the seed's window greedily, best first, whole if they fit. When none of the
NEIGHBOURS best fits any more, the best of them is cut; what is left of it is the next seed. Where no
unused document shares a token with the seed, the next one in order follows. A window stays open beyond
the end of a shard, so only the last window of a task is not full; it is cut into sequences whose lengths are
powers of two, and those are never padded. So nothing is padded at all.

The work is one pass over the scan, without a shuffle; a window never leaves its task. Documents meet in a
shard if they are near each other in the input, so cluster the input first where neighbours lie far apart.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.tasks import text_slices, texts_of

WINDOW = 4096
END = 2
SHARD_BYTES = 4 * 2**20
NEIGHBOURS = 32
# Words that one worker remembers the tokens of.
WORDS = 600_000

# BM25 with its customary constants.
_K1, _B = 1.2, 0.75

# Fixed value: the suffix of tokens that end a word.
_LAST = "</w>"
# Stands for the end of a word while it is merged; no word holds a line break.
_STOP = b"\n"


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordTokens:
    """Tokens of texts by a word-level BPE vocabulary file, remembered by word.

    White space ends words whatever stands around it, so a text has the tokens of its words in turn. Words of
    Latin letters go to a fast merger fed with the file's own merges; all others to the library itself.
    """

    def __init__(self, path: str, held: int = WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model = settings["model"]
        # The vocabulary's own way to cut a text; line breaks stand between words here.
        self.cut = regex.compile(settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        vocabulary, letters = model["vocab"], _bytes_of_letters()

        def merged(token: str) -> bytes:
            body, end = (token.removesuffix(_LAST), _STOP) if token.endswith(_LAST) else (token, b"")
            return bytes(letters[c] for c in body) + end

        # A last letter and its stop are one symbol from the outset, so these merges come before all others.
        order = [c + _LAST for c in letters] + [c for c in letters]
        order += ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
        ranks, self.numbers = {}, np.zeros(len(order) + 1, np.uint32)
        for token in order:
            key = merged(token)
            if key != _STOP and key not in ranks and token in vocabulary:
                self.numbers[len(ranks)] = vocabulary[token]
                ranks[key] = len(ranks)
        if _STOP not in ranks:
            ranks[_STOP] = len(ranks)
        self.last = np.zeros(len(ranks) + 1, bool)
        self.last[[rank for key, rank in ranks.items() if key.endswith(_STOP)]] = True
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.held = held
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.places), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begins[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.places.update(zip(words, range(first, first + n), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(words), np.uint8)
        # The fast way takes letters up to U+023F; U+0130 grows when lowered, and special tokens start with <|.
        odd = data >= 0xC9
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        breaks = np.flatnonzero(data == 0x0A)
        left = set(np.searchsorted(breaks, np.flatnonzero(odd)).tolist())
        plain = [w for i, w in enumerate(words) if i not in left] if left else words
        if plain:
            cut = self.cut.findall(b"\n".join(plain).decode().lower())
            breaks = np.array([i for i, piece in enumerate(cut) if piece == "\n"], np.int64)
            counts = np.diff(np.concatenate([[-1], breaks, [len(cut)]])) - 1
            found = self.fast.encode_to_numpy("\n".join([piece for piece in cut if piece != "\n"]) + "\n")
            ends = np.concatenate([[0], np.flatnonzero(self.last[found]) + 1])
            at = ends[np.concatenate([[0], np.cumsum(counts)])]
            self._keep(plain, self.numbers[found], np.diff(at))
        if left:
            others = [words[i] for i in sorted(left)]
            found = [x.ids for x in self.library.encode_batch([w.decode() for w in others], add_special_tokens=False)]
            self._keep(others, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The tokens of each text, as uint32."""
        split = [x.split() for x in texts]
        if len(self.places) > self.held:
            self._forget()
        unseen = list(set(chain.from_iterable(split)).difference(self.places))
        if unseen:
            self._learn(unseen)
        out = []
        for words in split:
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.begins[at] - ends + sizes, sizes) + np.arange(total)])
        return out


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    """One for each worker, kept from task to task."""
    return WordTokens(path)


class ShardIndex:
    """BM25 inverted index over the tokens of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        terms, tfs = [], []
        for ids in docs:
            found, counts = np.unique(ids, return_counts=True)
            terms.append(found)
            tfs.append(counts)
        self.sizes = np.array([len(x) for x in terms], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate(terms).astype(np.int64) if n else np.empty(0, np.int64)
        tf = np.concatenate(tfs).astype(np.float64) if n else np.empty(0)
        lengths = np.array([len(x) for x in docs], np.float64)
        norm = _K1 * (1 - _B + _B * lengths / max(1.0, lengths.mean())) if n else lengths
        places = np.repeat(np.arange(n, dtype=np.int64), self.sizes)
        self.reach = int(self.terms.max()) + 1 if len(self.terms) else 0
        self.df = np.bincount(self.terms, minlength=self.reach)
        order = np.argsort(self.terms, kind="stable")
        self.first = np.cumsum(self.df) - self.df
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        impact = tf * (_K1 + 1) / (tf + norm[places]) * idf[self.terms]
        self.places, self.impacts, self.n = places[order], impact[order], n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents of the shard for distinct query terms."""
        terms = terms[terms < self.reach]
        counts = self.df[terms]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.first[terms] - ends + counts, counts) + np.arange(total)
        return np.bincount(self.places[at], self.impacts[at], minlength=self.n)


class _Packer:
    """Fills windows of one task; pieces are (row, start, tokens), rows (doc_id, all its tokens)."""

    def __init__(self, window: int, first: int, with_ids: bool, neighbours: int = NEIGHBOURS):
        self.window, self.sequence, self.with_ids, self.neighbours = window, first, with_ids, neighbours
        self.open: list[tuple[tuple, int, np.ndarray]] = []
        self.free = window
        self.seed: np.ndarray | None = None  # distinct tokens of the open window's seed
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple[tuple, int, np.ndarray]]) -> None:
        offset = 0
        for (doc_id, total), start, ids in pieces:
            row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset)
            self.out.append((*row, ids.astype(np.int64)) if self.with_ids else row)
            offset += len(ids)
        self.sequence += 1

    def _put(self, row: tuple, start: int, ids: np.ndarray) -> None:
        self.open.append((row, start, ids))
        self.free -= len(ids)
        if not self.free:
            self._close(self.open)
            self.open, self.free, self.seed = [], self.window, None

    def add(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        """Pack all documents of a shard; the last window may stay open."""
        index = ShardIndex(docs)
        used = np.zeros(len(docs), bool)
        left = np.array([len(x) for x in docs], np.int64)

        def put(k: int) -> None:
            """As much of a document as the window takes; what is left of it goes on in the next one."""
            used[k], start = True, 0
            row = (doc_ids[k], len(docs[k]))
            while start < len(docs[k]):
                if self.seed is None:
                    self.seed = index.terms[index.begins[k] : index.begins[k] + index.sizes[k]]
                ids = docs[k][start : start + self.free]
                self._put(row, start, ids)
                start += len(ids)

        k = 0
        while True:
            while k < len(docs) and used[k]:
                k += 1
            if k == len(docs):
                return
            if self.seed is None:
                put(k)
                continue
            found = index.scores(self.seed)
            found[used] = 0
            many = min(self.neighbours, len(found))
            best = np.argpartition(-found, many - 1)[:many]
            best = best[np.lexsort((best, -found[best]))]
            best = best[found[best] > 0].tolist() or [k]
            seed, passed = self.seed, None
            for j in best:
                if left[j] <= self.free:
                    put(j)
                    if self.seed is not seed:  # the window is full
                        break
                elif passed is None:
                    passed = j
            if self.seed is seed and passed is not None:
                put(passed)

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        held, rest = self.window - self.free, list(self.open)
        while held:
            length = 1 << (held.bit_length() - 1)
            taken, missing = [], length
            while missing:
                row, start, ids = rest.pop(0)
                if len(ids) > missing:
                    rest.insert(0, (row, start + missing, ids[missing:]))
                    ids = ids[:missing]
                taken.append((row, start, ids))
                missing -= len(ids)
            self._close(taken)
            held -= length
        self.open, self.free, self.seed = [], self.window, None


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    *,
    tokenizer: str,
    window: int = WINDOW,
    end: int = END,
    with_ids: bool = True,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per piece: ``id``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids.

    ``tokenizer`` is the path of a word-level BPE file that exists on every executor. A document is its tokens and
    then ``end``; each token lies in one piece, a sequence holds at most ``window`` tokens, without gaps from
    offset 0. ``sequence_id`` has the partition in its upper half. Null and empty texts are one token;
    repeated rows and ids, and null ids, are documents of their own; an empty table gives an empty one. Other columns
    are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id}` {kind}, " + ", ".join(f"{n} bigint" for n in names) + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _tokens(tokenizer)
        packer = _Packer(window, TaskContext.get().partitionId() << 32, with_ids)
        key = None

        def made() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [()] * (8 if with_ids else 7)
            kinds = [key, *[pa.int64()] * 6, *([pa.list_(pa.int64())] if with_ids else [])]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [id, *names, *(["ids"] if with_ids else [])])

        for batch in batches:
            key = batch.schema.field(1).type
            for part in text_slices(batch, shard_bytes):
                ids = [np.append(x, np.uint32(end)) for x in tokens.encode(texts_of(part))]
                packer.add(part.column(1).to_pylist(), ids)
                yield made()
        if key is not None:
            packer.finish()
            yield made()

    return docs.select(text, id).mapInArrow(run, schema)
