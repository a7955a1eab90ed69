"""Encoding, chunk reuse and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldcast.llm import bpe, packing, tokens
from fieldcast.llm.common import stored, table
from fieldcast.llm.queries import op3_packing, op4_bpe_chunks, tokenizer_path

from .conftest import SF, small

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(5)
    pool = [chr(i) for i in range(0x3000)] + list(" \n\t\r\u0085\u00a0  ab'st<|>é") * 150
    for k in range(250):
        yield "".join(r.choice(pool) for _ in range(r.randint(0, 1500)))
        yield " ".join(r.choice(["the", "don't", "  x", "a\n", "<|endoftext|>", "foo.", "12", "é"]) for _ in range(r.randint(1, 600)))
        yield ("shared passage of words that stands in many texts " * 40)[k : k + 1800] + str(k)


def test_pieces_and_chunks_equal_the_library(library):
    plain = tokens.Encoder(PATH)
    chunked = bpe.ChunkEncoder(tokens.Encoder(PATH))
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        for ids in (plain.encode(text), chunked.ids(text)):
            assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert plain.decode(plain.encode(text)).decode() == library.decode(want, skip_special_tokens=False) == text
    assert chunked.reused and chunked.repaired


def test_cuts_depend_on_content_only():
    r = random.Random(1)
    words = [f"w{r.randint(0, 999)}" for _ in range(6000)]
    text = " ".join(words)
    moved = "another beginning of some length " * 9 + text
    chunks = lambda t: {t[a:b] for a, b in zip([0, *bpe.cuts(t)], bpe.cuts(t))}
    assert "".join(t for t in [text[a:b] for a, b in zip([0, *bpe.cuts(text)], bpe.cuts(text))]) == text
    assert len(chunks(text) & chunks(moved)) > 0.8 * len(chunks(text))
    assert bpe.cuts("") == [0] and max(map(len, chunks("a" * 50_000))) <= bpe.MOST_CHARS


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    got = op4_bpe_chunks(spark, SF).toPandas()
    want = {d: digests(library, t) for d, t in small(SF, "documents")[["doc_id", "text"]].itertuples(index=False)}
    assert {d: (n, i, t) for d, n, i, t in got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False)} == want


def test_odd_documents_round_trip(odd_docs, no_docs, library):
    got = sorted(map(tuple, bpe.round_trip_digests(odd_docs, PATH).select("n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert got == sorted(digests(library, r["text"]) for r in odd_docs.collect())
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert bpe.round_trip_digests(no_docs, PATH).count() == 0


def best_fit_by_search(lengths, window):
    rooms, out = [], []
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = [r for r in rooms if r >= lengths[at]]
        room = min(fitting, default=window)
        if fitting:
            rooms.remove(room)
        out.append(room)
        rooms.append(room - lengths[at])
    return sorted(out), len(rooms)


def test_best_fit_takes_the_tightest_window():
    r = np.random.default_rng(3)
    for window in (16, 100, 1024):
        lengths = r.integers(1, window + 1, 400)
        bins, offsets = packing.best_fit_decreasing(lengths, window)
        rooms, used = best_fit_by_search(lengths.tolist(), window)
        assert sorted((window - offsets).tolist()) == rooms and len(set(bins.tolist())) == used


def check_packed(rows, want, window=1024):
    """Every id lies in one piece, pieces fill their sequences without gaps."""
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window
    if want is not None:
        found = sorted((d, p) for (d, _), ps in pieces.items() for p in ps)
        assert found == sorted((d, (s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()))) for d, ids in want for s in range(0, len(ids), window))
    return len(places)


def test_packing_query(spark, library):
    rows = op3_packing(spark, SF).collect()
    want = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")) for d, t in small(SF, "documents")[["doc_id", "text"]].itertuples(index=False)]
    used = check_packed(rows, want)
    assert used <= 1.03 * sum(len(i) for _, i in want) / 1024 + 1


def test_packing_odd_documents(odd_docs, no_docs, library):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    check_packed(rows, None)
    assert sum(r["length"] for r in rows) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_shards_and_sequences(spark):
    docs = table(spark, SF, "documents").limit(60)
    cut = stored(packing.pieces(docs, PATH, 64), "pieces")
    packed = packing.pack(cut, 64, shard_pieces=20)
    check_packed(packed.collect(), None, 64)
    ids = bpe.encode(docs, PATH).join(cut.select("doc_id", "row").distinct(), "doc_id")
    with_end = ids.select("row", F.concat("ids", F.array(F.lit(0))).alias("ids"))
    made = packing.sequences(packed, with_end, 64).collect()
    assert {len(r["ids"]) for r in made} <= {64, 32, 16, 8, 4, 2, 1}
    assert len(made) == packed.select("sequence_id").distinct().count()
