"""Packing against the tokenizers library, and neighbours against BM25 written out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import packing
from lectern.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def tokens(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, docs, library, window=4096):
    """Every token of every document lies in one piece, sequences have no gaps and need no padding."""
    whole = {}
    for doc_id, text in docs:
        whole.setdefault(doc_id, []).append(tokens(library, text))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == whole.keys()
    for doc_id, own in by_doc.items():
        covered = Counter()
        for p in own:
            assert p["length"] > 0
            fits = [ids for ids in whole[doc_id] if len(ids) == p["doc_tokens"]]
            crcs = {zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for ids in fits}
            assert p["ids_crc32"] in crcs
            covered.update((p["doc_tokens"], i) for i in range(p["start"], p["start"] + p["length"]))
        wanted = Counter((len(ids), i) for ids in whole[doc_id] for i in range(len(ids)))
        assert covered == wanted
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]]
        assert ends[-1] == window or ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0


def test_words_have_the_librarys_tokens(spark, library):
    rng = random.Random(1)
    alphabet = "aZéßİıǅΣςσ'’.,_-12²½ªº́  \x0b\x1c中ก😀ﬁ"
    texts = ["".join(rng.choices(alphabet + "   etsrn", k=rng.randrange(60))) for _ in range(3000)]
    texts += ["it's we'll 'tis they'D x<|endoftext|>y <|startoftext|>", "", " ", "a" * 5000, "'s" * 50, "...!!!a,b.c"]
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts += [r["text"] or "" for r in sample]
    made = packing.WordTokens(PATH, held=2000)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        for text, got in zip(part, made.encode([t.encode() for t in part]), strict=True):
            assert got.tolist() == tokens(library, text)[:-1], text


def test_every_word_of_the_vocabulary(library):
    words = [w.removesuffix("</w>") for w in library.get_vocab() if w.endswith("</w>") and w.isascii()]
    got = packing.WordTokens(PATH).encode([w.encode() for w in words])
    assert [x.tolist() for x in got] == [tokens(library, w)[:-1] for w in words]


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(25)] + [np.array([39])]
    index = packing.ShardIndex(docs)
    mean = sum(map(len, docs)) / len(docs)
    for seed in docs[:5]:
        got = index.scores(np.unique(seed))
        for d, doc in enumerate(docs):
            score = 0.0
            for t in set(seed.tolist()):
                df, tf = sum(t in x for x in docs), int((doc == t).sum())
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
            assert got[d] == pytest.approx(score)
    assert packing.ShardIndex([]).scores(np.array([3])).tolist() == []


def test_neighbours_of_the_seed_fill_its_window():
    """Documents on two subjects, mixed: windows hold one subject as long as it lasts."""
    docs = [np.full(10, 100 + i % 2, np.uint32) for i in range(40)]
    packer = packing._Packer(100, 0, False)
    packer.add(list(range(40)), docs)
    packer.finish()
    subjects = {}
    for doc_id, _, _, _, _, sequence, _ in packer.out:
        subjects.setdefault(sequence, set()).add(doc_id % 2)
    assert sorted(map(sorted, subjects.values())) == [[0], [0], [1], [1]]


def test_cut_document_is_the_next_seed():
    docs = [np.full(70, 5, np.uint32), np.full(60, 5, np.uint32), np.full(200, 6, np.uint32)]
    packer = packing._Packer(100, 7, False)
    packer.add(["a", "b", "c"], docs)
    packer.finish()
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in packer.out] == [
        ("a", 0, 70, 7, 0),
        ("b", 0, 30, 7, 70),
        ("b", 30, 30, 8, 0),
        ("c", 0, 70, 8, 30),
        ("c", 70, 100, 9, 0),
        ("c", 170, 16, 10, 0),
        ("c", 186, 8, 11, 0),
        ("c", 194, 4, 12, 0),
        ("c", 198, 2, 13, 0),
    ]


@pytest.mark.parametrize("shard_bytes", [4 << 20, 3000])
def test_odd_rows(spark, library, shard_bytes):
    rows = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (None, "no number"), (None, None), (4, "word " * 30_000), (5, "日本語 " * 50)]
    rows += [(100 + i, f"some words {i % 7} of a text that is short") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, start int, length int, ids int").repartition(3)
    got = packing.pack(docs, tokenizer=PATH, shard_bytes=shard_bytes).collect()
    check(got, rows, library)
    for p in got:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
    assert packing.pack(docs.limit(0), tokenizer=PATH).collect() == []


def test_query_covers_all_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op11_packing"](spark, sf).collect(), docs, library)
