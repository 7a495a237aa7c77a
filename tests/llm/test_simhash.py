import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import simhash
from folioframe.llm.components import components
from folioframe.llm.common import read_table
from tests.llm.helpers import SF, awkward, documents, with_clashes


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_groups(rows):
    """component_id of rows (doc_id, text) by comparing all pairs of fingerprints."""
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    near = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    root = plain_components(distinct, near)
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], doc_id), doc_id)
    return [(d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)]


def by_id(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("text", ["", "One", "One two", "A B c d e f", "x y z x y z x y z", "É \x1c a\x0bb\x0cc"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for _ in range(400)})
    tree = simhash.BKTree(values)
    for query in values[:60]:
        assert sorted(tree.values[i] for i in tree.within(query, 2)) == sorted(
            v for v in values if (v ^ query).bit_count() <= 2)


@pytest.mark.parametrize("shard", [4096, 7])
def test_links_connect_what_all_pairs_connect(spark, shard):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1, 3}
    for centre in list(values)[:8]:
        for _ in range(25):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), shard=shard).collect()
    near = [(a, b) for a, b in combinations(sorted(values), 2) if (a ^ b).bit_count() <= 2]
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found]
    assert set(map(frozenset, got)) <= set(map(frozenset, near))
    assert plain_components(values, got) == plain_components(values, near)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(7, 7), (100, 101)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e}
    assert found == plain_components(nodes, edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_groups_of_the_test_documents(spark):
    table = read_table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    found = simhash.group(table, ["doc_id"]).select("doc_id", simhash.hexadecimal(), "component_id").collect()
    assert by_id(map(tuple, found)) == by_id(plain_groups(rows))
    assert len({r["component_id"] for r in found}) < len(rows)


def test_awkward_rows_and_clashing_columns(spark):
    table = with_clashes(awkward(spark))
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    found = simhash.group(table, ["doc_id"]).select("doc_id", simhash.hexadecimal(), "component_id").collect()
    assert by_id(map(tuple, found)) == by_id(plain_groups(rows))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(plain_fingerprint(text), []).append((doc_id is None, doc_id))
    best = {min(g)[1] for g in groups.values()}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(b for b in best if b is not None)


def test_keep_one_of_an_idless_group(spark):
    kept = simhash.keep_one(documents(spark, [(None, "a b c d"), (None, "a b c d"), (None, "other words are here")]))
    assert sorted(r["text"] for r in kept.collect()) == ["a b c d", "other words are here"]


def test_empty_table(spark):
    nothing = documents(spark, [(1, "x")]).filter(F.lit(False))
    assert simhash.group(nothing, ["doc_id"]).collect() == [] and simhash.keep_one(nothing).collect() == []
