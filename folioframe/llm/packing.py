"""Packing tokenised documents into fixed windows: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

WINDOW = 1024
END_ID = 0
# Leftover pieces packed together by one task; more of them are dealt to more tasks.
SHARD = 50_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, slot bigint"
PACKED = PIECES.replace("slot bigint", "sequence_id bigint, offset bigint")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str):
    """Token ids of a text by the byte-level vocabulary at `vocabulary`, no special token added; one that the text
    itself spells out is that one id.

    `ranks` names the same vocabulary in the form that a faster library with the same splitting rule reads; without
    it the `tokenizers` library does the work.
    """
    if ranks:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            special = {token["content"]: token["id"] for token in json.load(file).get("added_tokens", [])}
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, special_tokens=special, mergeable_ranks={
            token: rank for token, rank in merges.items() if rank not in special.values()})
        return lambda text: encoding.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class BestFit:
    """Open windows by free capacity, in a segment tree that finds the smallest sufficient capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}
        self.capacity, self.windows = capacity, 0

    def _change(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def _tightest(self, size: int) -> int | None:
        """The smallest capacity of at least `size` that an open window has left."""
        node = self.leaves + size
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece of `size`, the tightest window that has room, or else a new one."""
        free = self._tightest(size)
        if free is None:
            window, free = self.windows, self.capacity
            self.windows += 1
        else:
            window = self.open[free].pop()
            self._change(free, -1)
        left = free - size
        if left:
            self.open.setdefault(left, []).append(window)
            self._change(left, 1)
        return window, self.capacity - free


def cut(documents: DataFrame, vocabulary: str, ranks: str = "", window: int = WINDOW) -> DataFrame:
    """Pieces of every document's ids followed by the end id: full windows first, then the rest.

    `slot` numbers the pieces within and across tasks. Map-side; texts do not travel on.
    """
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, slot = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), slot))
                    slot += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)] if rows
                else [pa.array([], pa.int64())] * 6,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"])

    return source.mapInArrow(run, PIECES)


def pack(documents: DataFrame, vocabulary: str, ranks: str = "", window: int = WINDOW,
         shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Documents longer than a window are first cut into full windows, each a sequence of its own. What is left of every
    document is packed whole, longest first, into the open window that it fills best. The pieces (numbers only) are
    stored, and the left ones dealt evenly to tasks of about `shard` pieces, whatever their ids. NULL texts count as
    empty and give the end id alone; repeated rows and NULL ids each give their pieces.
    """
    pieces = stored(cut(documents, vocabulary, ranks, window), "pieces")
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(shards)))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table["slot"].to_numpy(), -table["length"].to_numpy()))
        windows = BestFit(window)
        placed = np.array([windows.place(int(n)) for n in table["length"].to_numpy()[order]], np.int64).reshape(-1, 2)
        sorted_table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).take(pa.array(order))
        # Sequences of full windows have even numbers, these odd ones.
        first = (int(key[0].as_py()) << 32) * 2 + 1
        return sorted_table.append_column("sequence_id", pa.array(first + 2 * placed[:, 0])).append_column(
            "offset", pa.array(placed[:, 1]))

    packed = dealt.groupBy("shard").applyInArrow(fit, PACKED)
    alone = full.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("slot") * 2).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return alone.unionByName(packed)
