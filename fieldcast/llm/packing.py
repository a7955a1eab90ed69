"""Best-fit decreasing packing of token sequences.

Documents are cut into full windows, which are sequences by themselves; the rests are packed. Rests are dealt by hash
into shards of bounded size; inside a shard they are placed longest first, each into the open window with the least
room that still holds it. A segment tree over remaining capacities finds that window in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, stored
from .tokens import encoder

WINDOW = 1024
SHARD_PIECES = 65_536
END_ID = 0
PIECE = "row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class OpenWindows:
    """Segment tree indexed by remaining capacity; a node counts the open windows below it."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``length``; it is removed."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 to ``window``); ties are placed in the given order."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, used = OpenWindows(window), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        found = tree.take(length)
        if found is None:
            found, used = (window, used), used + 1
        capacity, name = found
        bins[at], offsets[at] = name, window - capacity
        if capacity > length:
            tree.put(capacity - length, name)
    return bins, offsets


def _cut(path: str, window: int):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for rows in batches:
            out, source = [], []
            for at, (row, text) in enumerate(zip(rows["row"], rows["text"], strict=True)):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    checked = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + window)])
                    out.append((row, start, min(window, n - start), checked, n))
                    source.append(at)
            made = pd.DataFrame(out, columns=["row", "start", "length", "ids_crc32", "doc_tokens"], dtype=np.int64)
            yield made.assign(doc_id=rows["doc_id"].take(source).array)

    return cut


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut into full windows
    and a rest. ``row`` names the document's row, so repeated doc_ids stay apart. NULL texts count as empty."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(_cut(tokenizer, window), f"{PIECE}, doc_id {kind}")


def _place(window: int):
    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.assign(sequence_id=2 * ((int(key[0]) << 24) + bins) + 1, offset=offsets).drop(columns="shard")

    return place


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (row, start, length, anything else).

    Even sequence ids are full windows, odd ones are packed rests. Every piece lies in exactly one sequence and offsets
    are gapless. A shard holds about ``shard_pieces`` rests however many rows share a doc_id, since shards are dealt
    by row. An empty table gives none."""
    full = cut.where(F.col("length") == window)
    rest = cut.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_pieces))
    whole = full.select("*", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    packed = dealt.groupBy("shard").applyInPandas(_place(window), f"{kinds}, sequence_id bigint, offset bigint")
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Packs every document: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, window), "pieces")
    return pack(cut, window).drop("row")


def sequences(packed: DataFrame, tokens: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_starts). ``packed`` are pieces with (row, start, length,
    sequence_id, offset), ``tokens`` has (row, ids). A sequence meets in one group of at most ``window`` ids; it is
    padded to the window unless its length is a power of two."""
    part = packed.join(tokens, "row").select(
        "sequence_id", "offset", F.expr("slice(ids, cast(start as int) + 1, cast(length as int))").alias("part")
    )
    whole = part.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    ids = F.flatten(F.col("parts.part"))
    n = F.size(ids)
    missing = F.when(F.bit_count(n.cast("bigint")) == 1, 0).otherwise(window - n)
    return whole.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), missing)).alias("ids"), F.col("parts.offset").alias("doc_starts"))
