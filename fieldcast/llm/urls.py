"""URL filter by character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL a log-likelihood
difference per character. Host and path rules name the URLs to learn from and decide those they fit; the models
decide the rest against a threshold calibrated on held-out labelled URLs.

Characters are counted exactly, by their context and the character, in tables that grow with the URLs and are joined,
never collected. What a character adds to the difference depends on nothing but itself and the ORDER before it, so it
is worked out once for each such string and handed to blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship_package
from .common import bound_batches, fold, stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# --- fixed values: the rules ---
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# --- end of fixed values ---

ORDER = 4
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
STRENGTH = 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a byte plus one in a packed string: ORDER bytes of context and the character's last, in the low bits.
WIDTH = 9
CLASSES = ("rejected", "accepted")
#: Rows that are scored together.
BLOCK_BITS = 12
#: Width of a bin of the calibration histogram, in nats per character, and the bins on either side of zero.
BIN, BINS = 0.002, 4000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://(.*)", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def whole(url: Column) -> Column:
    """The URL with its host in lower case and all else as it is; empty for NULL, unchanged without ``://``."""
    url = F.coalesce(url, F.lit(""))
    start = F.regexp_extract(url, "(?s)^(.*?://)", 1)
    host, _ = parts(url)
    return F.concat(start, host, F.substring(url, F.length(start) + F.length(host) + 1, F.length(url)))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or NULLs. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def packed(url: str) -> np.ndarray:
    """Each byte of the URL with the ORDER bytes before it as one integer; zero bytes stand before the first."""
    raw = np.frombuffer(b"\0" * ORDER + url.encode(), dtype=np.uint8).astype(np.int64) + 1
    out = np.zeros(len(raw) - ORDER, dtype=np.int64)
    for back in range(ORDER + 1):
        out |= raw[ORDER - back : len(raw) - back] << WIDTH * back
    return out


def _distinct(urls: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *map(packed, urls)]), return_counts=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        accepted, texts = np.array(rows["accepted"].to_pylist(), dtype=bool), np.array(rows["url"].to_pylist(), dtype=object)
        for k in (0, 1):
            grams, n = _distinct(texts[accepted == bool(k)])
            yield pa.RecordBatch.from_pydict({"gram": grams} | {c: n * (k == i) for i, c in enumerate(CLASSES)})


def fit(labelled: DataFrame) -> DataFrame:
    """(gram, rejected, accepted): how often each packed string stands in all rows (url, accepted)."""
    ship_package(labelled.sparkSession)
    bound_batches(labelled.sparkSession)
    found = labelled.select("url", "accepted").mapInArrow(_counted, "gram bigint, rejected bigint, accepted bigint")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in CLASSES))


def differences(grams: DataFrame) -> DataFrame:
    """(gram, difference) for every row of counts (gram, rejected, accepted): the log-likelihood of the last character
    under the accepted model less that under the rejected.

    Each order mixes its own estimate with the next shorter one's, the more so the rarer the context. A context has at
    most 257 characters after it and a string as many before it, so no join or window has a larger group."""
    last = lambda order: F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (order + 1)) - 1))
    shorter = None
    for order in range(ORDER + 1):
        here = grams.groupBy(last(order).alias("gram")).agg(*(F.sum(c).alias(c) for c in CLASSES))
        context = Window.partitionBy(F.shiftright("gram", WIDTH))
        here = here.select("gram", *CLASSES, *(F.sum(c).over(context).alias(f"all_{c}") for c in CLASSES))
        if shorter is None:
            here = here.withColumns({f"p_{c}": F.lit(1 / 256) for c in CLASSES})
        else:
            here = here.withColumn("shorter", last(order - 1)).join(shorter, "shorter")
        mixed = ((F.col(c) + STRENGTH * F.col(f"p_{c}")) / (F.col(f"all_{c}") + STRENGTH) for c in CLASSES)
        shorter = here.select(F.col("gram").alias("shorter"), *(p.alias(f"p_{c}") for c, p in zip(CLASSES, mixed, strict=True)))
    return shorter.select(F.col("shorter").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("difference"))


def _strings_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        blocks, texts = rows["block"].to_numpy(), np.array(rows["key"].to_pylist(), dtype=object)
        for block in np.unique(blocks):
            grams, _ = _distinct(texts[blocks == block])
            yield pa.RecordBatch.from_pydict({"block": np.full(len(grams), block), "gram": grams})


def _score_block(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A block's rows with the mean of what the characters of ``key`` add; 0 for an empty one."""
    grams, first = np.unique(known["gram"].to_numpy(), return_index=True)
    adds, out = known["difference"].to_numpy()[first], np.zeros(len(rows))
    for i, url in enumerate(rows["key"].to_pylist()):
        if url:
            out[i] = adds[np.searchsorted(grams, packed(url))].mean()
    return rows.append_column("difference", pa.array(out, pa.float64()))


def score(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` (block, key without NULLs, anything else) with ``difference`` of the text in ``key`` under the counts
    of ``fit``. ``pages`` has to be stored, with blocks of bounded size."""
    spark = pages.sparkSession
    ship_package(spark)
    bound_batches(spark)
    used = stored(pages.select("block", "key").mapInArrow(_strings_of_blocks, "block bigint, gram bigint"), "url_strings")
    unseen = used.select("gram", *(F.lit(0).cast("bigint").alias(c) for c in CLASSES)).distinct()
    grams = stored(counts.unionByName(unseen).groupBy("gram").agg(*(F.sum(c).alias(c) for c in CLASSES)), "url_counts")
    adds = used.join(differences(grams), "gram")
    schema = StructType([*pages.schema.fields, StructField("difference", DoubleType())])
    return pages.groupBy("block").cogroup(adds.groupBy("block")).applyInArrow(_score_block, schema)


def contexts(url: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For ``difference``. Per order 0 to ORDER: slots of each position's context, and of context and character together."""
    raw = np.frombuffer(b"\0" * ORDER + url.encode(), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    now, before, joint = raw[ORDER:], [], []
    state = np.zeros(len(now), dtype=np.uint64)
    shift = np.uint64(64 - SLOT_BITS)
    for order in range(ORDER + 1):
        if order:
            state = (state + raw[ORDER - order : len(raw) - order]) * STEP
        salted = (state + np.uint64(order + 1)) * STEP
        before.append((salted >> shift).astype(np.int64))
        joint.append((((salted ^ (salted >> np.uint64(29))) + now) * STEP >> shift).astype(np.int64))
    return before, joint


def difference(url: str, counts: np.ndarray) -> float:
    """What ``score`` gives, of one URL from counts [accepted, context or joint, slot] hashed into memory: a second
    form for tests on small tables, which no query uses."""
    if not url:
        return 0.0
    before, joint = contexts(url)
    logs = []
    for model in counts:
        p = np.full(len(joint[0]), 1 / 256)
        for c, j in zip(before, joint, strict=True):
            p = (model[1][j] + STRENGTH * p) / (np.maximum(model[0][c], model[1][j]) + STRENGTH)
        logs.append(np.log(p).sum())
    return float(logs[1] - logs[0]) / len(joint[0])


def threshold(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy over (difference, accepted), from a histogram of fixed size; 0 if a
    class is missing. Of equally good ones the one closest to 0."""
    at = F.least(F.greatest(F.floor(F.col("difference") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin")
    rows = scored.groupBy(at, "accepted").count().toPandas()
    bins = np.zeros((2, 2 * BINS + 1))
    np.add.at(bins, (rows["accepted"].astype(int), rows["bin"].astype(int) + BINS), rows["count"])
    if not bins.sum(axis=1).all():
        return 0.0
    share = np.cumsum(bins, axis=1) / bins.sum(axis=1, keepdims=True)
    below = np.concatenate([[[0], [0]], share], axis=1)
    gain = (1 - below[1]) + below[0]
    edges = (np.arange(len(gain)) - BINS) * BIN
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) for every row of ``pages`` (page_id, url, anything else).

    Labelled URLs are those a rule fits; the models learn from all of them but the fold of page_ids with remainder 0,
    which calibrates the threshold. A NULL page_id is used for learning. Rules see host and path, the models the whole
    URL with scheme, query and fragment. A NULL url or one without ``://`` has empty host and path; a NULL or empty one
    has difference 0. Without both classes the threshold is 0."""
    host, path = parts(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"), whole(F.col("url")).alias("key"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    known = known.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "key", block)
    known = stored(known, "urls")
    accepted = (F.col("ruled") == "allow").alias("accepted")
    held = F.coalesce(fold(F.col("page_id")) == 0, F.lit(False))
    counts = fit(known.where(F.col("rule").isNotNull() & ~held).select(F.col("key").alias("url"), accepted))
    scored = stored(score(known, counts), "scored_urls")
    limit = threshold(scored.where(F.col("rule").isNotNull() & held).select("difference", accepted))
    by_model = F.when(F.col("difference") >= limit, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "difference")
