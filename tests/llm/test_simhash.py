import re

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    values = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ np.uint64(f)) <= 2):
            a, b = find(f), find(distinct[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least = {}
    for i, f in zip(ids, prints, strict=True):
        r = find(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(find(f)) for f in prints]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, prints = [d["doc_id"] for d in docs], [plain_fingerprint(d["text"]) for d in docs]
    expected = [(i, f"{f:016x}", c) for i, f, c in zip(ids, prints, plain_components(ids, prints), strict=True)]
    assert rows_of(QUERIES["op1_simhash"](spark, sf)) == sorted(expected, key=repr)


def test_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "y"), (3, " \t\n", "z"), (None, "a b", "x"), (9, "A B", "x"), (7, "a  b c d" * 9000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    expected = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    groups = plain_components([i for i, _ in expected], [f for _, f in expected])
    wanted = [(i, f"{f:016x}", g) for (i, f), g in zip(expected, groups, strict=True)]
    assert rows_of(simhash.near_copies(docs)) == sorted(wanted, key=repr)
    assert simhash.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_are_whole_in_crowded_blocks(spark, crowd):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            flips = rng.integers(0, 64, rng.integers(0, 6))
            prints.add(b ^ sum({1 << int(k) for k in flips}))
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, crowd)).collect()}
    ordered = sorted(prints)
    groups = plain_components(ordered, ordered)
    ours, theirs = {}, {}
    for f, g in zip(ordered, groups, strict=True):
        ours.setdefault(found.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        theirs.setdefault(g, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
