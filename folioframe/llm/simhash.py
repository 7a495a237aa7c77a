"""Near-duplicate groups: SimHash fingerprints linked within a Hamming radius by BK-trees.

Fingerprints that differ in at most two bits agree on two of four 16-bit blocks, so each fingerprint is filed under
its six pairs of blocks. The fingerprints of a file are a shard of bounded size (large files are cut into shards, and
every two of them meet); a BK-tree over the shard, whose children are keyed by their distance to the parent, is
searched along the edges within the radius. A shard gives a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import map_texts, row_key, stored, unused
from folioframe.llm.components import components

RADIUS = 2
BLOCKS = 4
SHARD = 4096
SEED = 42
WORDS = 3
FIELDS = [T.StructField("fp", T.LongType())]
_CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's three-word shingles, as an unsigned number; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words))
    firsts, lasts = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, seed = xxhash.xxh64_digest, SEED
    counts = np.zeros(64, np.int64)
    for at in range(0, len(firsts), _CHUNK):
        hashes = b"".join([
            digest(joined[a:b], seed) for a, b in zip(firsts[at:at + _CHUNK], lasts[at:at + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(firsts)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


class BKTree:
    """Distinct numbers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self, values: Iterable[int] = ()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.values:
            node = 0
            while True:
                distance = (self.values[node] ^ value).bit_count()
                if not distance:
                    return
                following = self.children[node].get(distance)
                if following is None:
                    self.children[node][distance] = len(self.values)
                    break
                node = following
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members at most `radius` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)
        return found


def forest(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between the queries and the tree's members, reduced to a spanning forest."""
    tree = BKTree(tree_values)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for query in queries:
        for position in tree.within(query, radius):
            a, b = root(query), root(tree.values[position])
            if a != b:
                parent[b] = a
                links.append((query, tree.values[position]))
    return links


def links(fingerprints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect the distinct values `fp` as their pairs within `radius` do."""
    if radius >= BLOCKS - 1:
        raise ValueError(f"{BLOCKS} blocks find pairs of at most {BLOCKS - 2} differing bits")
    size = 64 // BLOCKS
    masks = []
    for pair in combinations(range(BLOCKS), BLOCKS - radius):
        mask = sum(((1 << size) - 1) << (size * block) for block in pair)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    files = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, mask in enumerate(masks)
    ])).alias("file")).select("fp", "file.k", "file.v")
    shared = files.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = files.join(shared, ["k", "v"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("fp", "k"), F.col("shards")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # At most about two shards a group: the counts above cut larger files.
    groups = met.groupBy("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("fp"))).alias("tree"),
        F.collect_list(F.when(F.col("own") != F.least("own", "other"), F.col("fp"))).alias("queries"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for tree, queries, i, j in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                unsigned = [v & ((1 << 64) - 1) for v in tree]
                others = unsigned if i == j else [v & ((1 << 64) - 1) for v in queries]
                found += forest(unsigned, others, radius)
            signed = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])

    return groups.select("tree", "queries", "i", "j").mapInArrow(search, "a bigint, b bigint")


def group(documents: DataFrame, keep: list[str], radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """`keep` columns beside `fp` (the fingerprint as a signed number) and `component_id`, for every row.

    `component_id` is the smallest non-NULL doc_id among the rows reachable over links of fingerprints that differ in
    at most `radius` bits; NULL only if all of them lack an id. NULL texts count as empty; texts without words share
    the fingerprint zero. Equal fingerprints are one node, so copies are never paired. Whole texts are read once,
    map-side; the table of `keep` and fingerprints is stored.
    """
    columns = list(dict.fromkeys(["doc_id", *keep]))
    table = stored(map_texts(documents, columns, lambda texts: {
        "fp": [f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in texts]}, FIELDS), "simhash")
    nodes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = stored(components(links(nodes, radius, shard)).withColumnRenamed("node", "fp"), "simhash-roots")
    grouped = roots.join(nodes, "fp")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return table.join(labels, "fp").select(*keep, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of `documents`, one of each group: the one with the smallest doc_id (NULL last), ties by a hash of all
    columns. All columns are kept, whatever their names; rows equal in all columns count as one row."""
    row = unused([*documents.columns, "doc_id", "fp", "component_id"], "row")
    marked = documents.withColumn(row, row_key(documents))
    found = group(marked.select("doc_id", "text", row), ["doc_id", row], radius, shard)
    # Equal fingerprints without any id still form a group, told by the fingerprint itself.
    chosen = found.groupBy(F.coalesce(F.col("component_id"), F.col("fp")).alias("c"), F.isnull("component_id")).agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", row)).alias("best"))
    rows = chosen.select(F.col("best")[row].alias(row)).distinct()
    return marked.join(rows, row, "left_semi").dropDuplicates([row]).select(
        *[F.col(f"`{c}`") for c in documents.columns])
