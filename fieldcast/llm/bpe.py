"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over characters cuts texts into chunks, so passages that documents share give the same chunks wherever
they stand. A chunk is encoded once and its ids are reused. Near a chunk's ends those ids depend on what follows or
precedes, so every join is repaired: the text between an anchor in the left chunk and one in the right chunk is encoded
again, and the window is widened by an anchor on either side until its ids agree with the reused ones at both edges.

Documents are first placed by their smallest sentence hash, ties spread by doc_id: copies and near copies meet in the
same or neighbouring partitions, where their chunks are reused, and a large group of copies is still dealt over many
tasks. The table of chunks lives in the Python worker and is bounded by its size in characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches
from .tokens import SAFE_SPACE, Encoder, encoder

HASH_WINDOW = 24
MEAN_BITS = 10
LEAST_CHARS = 256
MOST_CHARS = 8192
CACHE_CHARS = 12_000_000
SENTENCE_CHARS = 20
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


class Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.full(size, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
            for steps in (self.up, self.down):
                steps[0] = 1
                np.multiply.accumulate(steps, out=steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def cuts(text: str) -> list[int]:
    """End of every chunk. A cut follows a window of characters whose Rabin hash has its top bits zero, so it depends
    on those characters alone; chunks have at least LEAST_CHARS (the last may have fewer), at most MOST_CHARS."""
    n = len(text)
    if n <= LEAST_CHARS:
        return [n]
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    up, down = POWERS.get(n)
    total = np.cumsum((points + np.uint64(1)) * up, dtype=np.uint64)
    window = total[HASH_WINDOW:] - total[:-HASH_WINDOW]
    window *= down[: n - HASH_WINDOW]
    window *= np.uint64(MIX)
    ends = np.flatnonzero(window >> np.uint64(64 - MEAN_BITS) == 0) + HASH_WINDOW + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MOST_CHARS:
            last += MOST_CHARS
            out.append(last)
        if end - last >= LEAST_CHARS or end == n:
            out.append(end)
            last = end
    return out if out[-1] == n else [*out, n]


class Chunk:
    """Ids of a chunk's inside, between two anchors (safe spaces), and the texts on either side of it.

    ``edge`` are the pieces next to the anchors, by which agreement is checked."""

    __slots__ = ("first", "head", "ids", "last", "tail")

    def __init__(self, text: str, encode: Encoder) -> None:
        self.ids = None
        # four anchors: an inside, and a piece on each side of it to widen the window by
        anchors = edge_anchors(text)
        if not anchors:
            return
        ids = encode.encode(text)
        ends = np.cumsum(encode.token_lengths[np.frombuffer(ids, dtype="<u4")])
        begin, inner = (len(text[:a].encode()) for a in anchors[:2])
        outer, stop = (int(ends[-1]) - len(text[a:].encode()) for a in anchors[2:])
        places = [begin, inner, outer, stop]
        at = np.searchsorted(ends, places)
        if not np.array_equal(ends[at], places):
            return
        a, b, c, d = (4 * (int(x) + 1) for x in at)
        self.first, self.last = ids[a:b], ids[c:d]
        self.head, self.ids, self.tail = text[: anchors[1]], ids[b:c], text[anchors[2] :]


def edge_anchors(text: str) -> list[int] | None:
    """The first two and the last two safe spaces of a text, if it has four or more."""
    first = [m.start() for m in islice(SAFE_SPACE.finditer(text), 2)]
    for reach in (100, len(text)):
        base = max(0, len(text) - reach)
        last = [base + m.start() for m in SAFE_SPACE.finditer(text[base:])][-2:]
        if len(last) == 2:
            break
    # a space at the start of the slice has nothing before it and is never matched, so the slice loses no exactness
    return [*first, *last] if len(first) == 2 and len(last) == 2 and first[1] < last[0] else None


class ChunkEncoder:
    def __init__(self, encode: Encoder) -> None:
        self.encode, self.chunks, self.held, self.reused, self.repaired = encode, {}, 0, 0, 0

    def chunk(self, text: str) -> Chunk:
        found = self.chunks.get(text)
        if found is None:
            if self.held > CACHE_CHARS:
                self.chunks.clear()
                self.held = 0
            found = self.chunks[text] = Chunk(text, self.encode)
            self.held += len(text)
        else:
            self.reused += 1
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text from its chunks. A window that does not agree with a chunk's edge swallows the chunk and
        goes on to the next, up to the whole text."""
        ends = cuts(text)
        if len(ends) == 1:
            return self.encode.encode(text)
        out: list[bytes] = []
        window, left = "", b""  # text still to be encoded, and the ids that its beginning has to agree with
        at = 0
        for end in ends:
            part = text[at:end]
            at = end
            chunk = self.chunk(part)
            if chunk.ids is None:
                window += part
                continue
            again = self.encode.encode(window + chunk.head)
            self.repaired += 1
            if not (again.startswith(left) and again.endswith(chunk.first)):
                window += part
                continue
            out += [again, chunk.ids]
            window, left = chunk.tail, chunk.last
        out.append(self.encode.encode(window))
        if not out[-1].startswith(left):
            return self.encode.encode(text)
        return b"".join(out)


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One per Python worker and tokenizer, so chunks are reused across batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(encoder(path))
    return _ENCODERS[path]


def near(text: Column) -> Column:
    """Smallest hash of a text's longer sentences and lines: equal for copies, and for most near copies. A text without
    any has its own hash."""
    text = F.coalesce(text, F.lit(""))
    longer = F.filter(F.split(text, "[.\n]"), lambda s: F.length(s) >= SENTENCE_CHARS)
    return F.coalesce(F.array_min(F.transform(longer, lambda s: F.xxhash64(s))), F.xxhash64(text))


def _placed(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").repartitionByRange(near(F.col("text")), F.xxhash64("doc_id"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids as array<int>) for every row; NULL texts have no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = chunk_encoder(tokenizer).ids
        for rows in batches:
            ids = [np.frombuffer(of(t or ""), dtype="<u4").astype(np.int32) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": ids})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _placed(docs).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = encoder(tokenizer).decode
        for rows in batches:
            texts = [of(np.asarray(i, dtype="<u4").tobytes()).decode() for i in rows["ids"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "text": texts})

    ship_package(encoded.sparkSession)
    bound_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ``encode`` and ``decode`` in one pass, without
    carrying the ids through the engine. NULL and empty texts have no tokens and the digests of the empty string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = chunk_encoder(tokenizer)
        names = [str(i) for i in range(len(chunks.encode.token_bytes))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for rows in batches:
            out = []
            for text in rows["text"]:
                ids = chunks.ids(text or "")
                listed = ",".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
                out.append((len(ids) // 4, sha(listed.encode()), sha(chunks.encode.decode(ids))))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield made.assign(doc_id=rows["doc_id"].array)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _placed(docs).mapInPandas(run, f"n_tokens bigint, ids_sha256 string, decoded_sha256 string, doc_id {kind}")
