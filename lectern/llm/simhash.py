"""Near copies by SimHash: fingerprints of 64 bits, linked where at most two bits differ.

Two fingerprints at that distance agree on two of four 16-bit blocks at least, so they meet in one
of six joins on a pair of blocks; the Hamming distance is then verified. Only distinct fingerprints take
part, exact copies follow their fingerprint. A block that more than CROWD fingerprints share is not
paired off: its fingerprints meet at the at most 65 fingerprints one flipped bit away, where any two
differ by two bits at most, and are linked to the least of them. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import stored, text_slices, texts_of

SHINGLE = 3
BITS_APART = 2
CROWD = 64


def _fingerprint(text: bytes, width: int) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    begins = np.concatenate([[0], ends[:-width] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], ">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` (bigint) of every row. Words are cut at ASCII white space and A-Z lowered.

    Texts of fewer than ``width`` words are one shingle; null and wordless texts have fingerprint 0.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprint(x, width) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int64())], [id, "fp"])

    return docs.select(text, id).mapInArrow(run, f"`{id}` {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a`` > ``b`` of distinct fingerprints ``fp`` whose closure is that of all close pairs.

    Every close pair of a block up to ``crowd`` is listed; in larger blocks links form stars.
    """
    blocks = [0xFFFF << (16 * k) for k in range(4)]
    masks = [_signed(x | y) for x, y in combinations(blocks, 2)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    sizes = keyed.groupBy("block", "key").count().where("count > 1")
    members = stored(keyed.join(sizes, ["block", "key"]), "blocks")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = members.where(F.col("count") <= crowd)
    pairs = (
        few.select("block", "key", F.col("fp").alias("a"))
        .join(few.select("block", "key", F.col("fp").alias("b")), ["block", "key"])
        .where((F.col("a") > F.col("b")) & (distance <= BITS_APART))
        .select("a", "b")
    )
    around = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << k)) for k in range(64)])
    crowded = members.where(F.col("count") > crowd).select("fp").distinct()
    stars = (
        crowded.select("fp", F.explode(F.transform(around, lambda m: m.bitwiseXOR(F.col("fp")))).alias("key"))
        .groupBy("key")
        .agg(F.collect_set("fp").alias("fps"))  # 65 at most
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .where((F.col("a") > F.col("b")) & (distance <= BITS_APART))
        .select("a", "b")
    )
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for nodes ``a`` > ``b`` of edges.

    Alternates two star contractions until nothing changes: all neighbours above a node are hung on its
    least neighbour, then all below. Each round is a join and an aggregation and is stored.
    """
    edges = stored(edges, "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(least, "a").select(hung.alias("e")).select("e.a", "e.b").where("a > b").distinct()
        edges = stored(small, "edges")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, one row per row of ``docs``.

    ``component_id`` is the least id that can be reached over links. Null ids take part in links but
    never name a component unless all its ids are null. Repeated rows share a component; an empty
    table gives an empty one; other columns are not read.
    """
    rows = stored(fingerprints(docs, id, text).withColumnRenamed(id, "id"), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    stars = components(links(nodes, crowd))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    labels = stored(rooted.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
