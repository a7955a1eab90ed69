"""SimHash near-duplicates by meeting in the middle.

Fingerprints within ``radius`` bits of each other share a fingerprint within half that radius of both. Every distinct
fingerprint therefore emits all variants within half the radius; a shuffle on the variants brings partners together.
A variant has at most as many members as its ball has fingerprints (65 for radius 2), so no group grows with the data:
copies collapse to one fingerprint before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, stored
from .components import connected_components

BITS = 64
SHINGLE = 3
SEED = 42
SLICE = 1 << 14


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one text: A-Z lower-cased, words between ASCII white space, three-word shingles with
    repeats; fewer words are one shingle, no word gives zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles = iter(words)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        rows = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        prints = np.array([fingerprint(t) for t in rows["text"]], dtype=np.int64)
        yield rows.drop(columns="text").assign(fp=prints)


def fingerprints(docs: DataFrame, **carried: Column) -> DataFrame:
    """(doc_id, carried columns, fp) for every row; NULL texts count as empty."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    given = docs.select("doc_id", *[c.alias(n) for n, c in carried.items()], F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    return given.mapInPandas(_fingerprints, f"{kinds}, fp bigint")


def ball(radius: int) -> list[int]:
    """Masks with at most ``radius`` bits set, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that span all pairs of fingerprints ``fp`` within ``radius`` bits (an even number).

    Members of one variant's ball are all within the radius of each other, so neighbours in the ball's order link them
    all without emitting its pairs; every collision is still verified."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    fp = F.col("fp")
    variants = distinct.select("fp", F.explode(F.array(*[fp.bitwiseXOR(F.lit(m)) for m in ball(radius // 2)])).alias("variant"))
    order = Window.partitionBy("variant").orderBy("fp")
    met = variants.select("fp", F.lag("fp").over(order).alias("before")).where("before IS NOT NULL")
    near = F.bit_count(fp.bitwiseXOR(F.col("before"))) <= radius
    return met.where(near).select(F.col("fp").alias("u"), F.col("before").alias("v")).distinct()


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, label) for every fingerprint of stored ``rows`` (doc_id, fp); label names the component by a
    fingerprint."""
    sizes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(sizes.select("fp"), radius)).select(F.col("node").alias("fp"), "label")
    placed = sizes.join(found, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    placed = stored(placed, "labels")
    roots = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    return placed.join(roots, "label").select("fp", "component_id", "label")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs`` (doc_id, text, anything else).

    component_id is the smallest doc_id reachable over links. NULL and empty texts have fingerprint zero and link like
    any other. Rows with a NULL doc_id take part; a component without any id has a NULL component_id. Repeated rows
    give repeated rows; an empty table gives none."""
    rows = stored(fingerprints(docs), "fingerprints")
    by_print = _labelled(rows, radius).select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, once if it is repeated.

    Rows without a doc_id come last: such a row stays only if its component has none with an id. Different texts may
    share a doc_id, or have none: in one component the text with the smallest digest stays, in two components one text of
    each."""
    columns = docs.columns
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = stored(fingerprints(docs, digest=digest), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    survivors = rows.join(_labelled(rows, radius), "fp").groupBy("label").agg(F.min(order).alias("one"))
    survivors = survivors.select(F.col("one.doc_id").alias("_doc_id"), F.col("one.digest").alias("_kept"))
    marked = docs.withColumn("_digest", digest)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_digest") == F.col("_kept"))
    return marked.join(survivors, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).select(*columns)
