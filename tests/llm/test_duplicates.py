"""Near-duplicates of texts and of embeddings, and components, against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldcast.llm import embeddings, simhash
from fieldcast.llm.components import connected_components
from fieldcast.llm.queries import op5_simhash, op6_embeddings

from .conftest import SF, small


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, prints):
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    found = roots(len(prints), pairs)
    least = {r: min((ids[i] for i in range(len(ids)) if found[i] == r and ids[i] is not None), default=None) for r in found}
    return [least[r] for r in found]


def test_simhash_query(spark):
    docs = small(SF, "documents")
    prints = [fingerprint(t) for t in docs["text"]]
    want = set(zip(docs["doc_id"], (f"{p:016x}" for p in prints), components_of(docs["doc_id"].tolist(), prints), strict=True))
    assert {tuple(r) for r in op5_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_simhash_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    prints = [fingerprint(r["text"]) for r in rows]
    want = sorted(zip([str(r["doc_id"]) for r in rows], (f"{p:016x}" for p in prints), map(str, components_of([r["doc_id"] for r in rows], prints)), strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns and set(kept.columns) == set(odd_docs.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({r["doc_id"] for r in rows if r["doc_id"] is not None and (str(r["doc_id"]), f"{fingerprint(r['text']):016x}", str(r["doc_id"])) in want})
    assert ids.count(None) == 0  # its text has a row with an id


def test_one_document_of_each_group_whatever_the_ids(spark):
    other = " ".join(f"other{i}" for i in range(30))
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "a"), (1, other, "a"), (1, text, "b"), (2, text, "a"), (3, other, "a"), (4, None, "a"), (4, "", "b"), (None, text, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = [(r["doc_id"], r["text"] or "") for r in simhash.keep_one(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, text), (1, other), (4, "")]))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_copies_without_an_id_leave_one(spark):
    text, other = " ".join(f"word{i}" for i in range(30)), " ".join(f"other{i}" for i in range(30))
    df = spark.createDataFrame([*[(None, text)] * 5, (7, text), *[(None, other)] * 3], "doc_id long, text string").repartition(4)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str) == sorted([(7, text), (None, other)], key=str)


def test_links_find_every_close_pair(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(2**62), 2**62, 40)
    prints = sorted({int(b) ^ int(m) for b in base for m in [0, *(1 << int(k) for k in r.integers(0, 62, 6)), 3 << 5, 7 << 9]})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    linked = [(prints.index(x["u"]), prints.index(x["v"])) for x in simhash.links(df).collect()]
    assert all(((prints[u] ^ prints[v]) % 2**64).bit_count() <= 2 for u, v in linked)
    exact = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2]
    assert roots(len(prints), linked) == roots(len(prints), exact)


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    links = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert connected_components(links.limit(0)).count() == 0


def brute(vectors, least=0.95):
    v = np.stack(vectors).astype(float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    hit = v @ v.T >= least
    np.fill_diagonal(hit, False)
    return hit


def test_embedding_query(spark):
    given = small(SF, "embeddings")
    hit = brute(given["embedding"])
    found = roots(len(given), list(zip(*np.nonzero(hit), strict=True)))
    ids = given["vec_id"].tolist()
    least = {r: min(ids[i] for i in range(len(ids)) if found[i] == r) for r in found}
    want = {(ids[i], int(hit[i].sum()), least[found[i]], ids[i] == least[found[i]]) for i in range(len(ids))}
    assert {tuple(r) for r in op6_embeddings(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()} == want


def test_embeddings_in_small_blocks_with_dense_groups(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(5, 12))
    v = np.concatenate([c + r.normal(scale=0.12, size=(150, 12)) for c in centres] + [np.repeat(centres[:1], 60, axis=0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    hit = brute(v)
    found = roots(len(v), list(zip(*np.nonzero(hit), strict=True)))
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embeddings.near_duplicates(df, block=200, lead=3).collect()}
    assert got == {i: (int(hit[i].sum()), found[i]) for i in range(len(v))}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], None), (5, [nan, 1.0], "x"),
        (6, [inf, 1.0], "x"), (7, [None, 1.0], "x"), (8, [], "x"), (None, [3.0, 0.01], "x"), (9, [1.0, 0.0, 0.0], "x"), (10, [0.0, 1e300], "x"), (11, [0.0, 1e-300], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size string").withColumn("key", F.lit("clash"))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(df).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([*alone, ("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("None", 3, "1", False), ("10", 1, "10", True), ("11", 1, "10", False)])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [0.3162, 0.1414, 0.01])
def test_block_pairs_are_those_within_reach_once(spark, width):
    """Boxes of all shapes, boxes that touch and boxes exactly one width apart, in two vector lengths."""
    r = np.random.default_rng(8)
    lead, reach, boxes = 4, width * width, []
    for n in range(90):
        lo = r.uniform(-1, 0.9, lead)
        hi = np.minimum(1.0, lo + r.choice([0, 0.02, 0.4, 2.0], lead, p=[0.3, 0.4, 0.2, 0.1]))
        if n % 9 == 0 and n:
            lo = np.array(boxes[-1][3]) + width * np.eye(lead)[n % lead]
            hi = lo + 0.01
        boxes.append((16 + n % 2 * 8, n, lo.tolist(), hi.tolist()))
    rows = spark.createDataFrame(boxes, "size int, block long, lo array<double>, hi array<double>")
    gap = lambda x, y: embeddings._gap(*(np.array(v) for v in (x[2], x[3], y[2], y[3])))
    want = sorted((x[0], x[1], y[1]) for x in boxes for y in boxes if x[0] == y[0] and x[1] <= y[1] and gap(x, y) <= reach + embeddings.EDGE)
    assert sorted(map(tuple, embeddings._pairs(rows, width, reach, lead).collect())) == want
    assert 1 <= embeddings._axes(width, 6) <= 6 and embeddings._pairs(rows.limit(0), width, reach, lead).count() == 0
