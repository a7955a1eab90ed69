"""Benchmark decontamination with a broadcast set of the benchmark's word windows. Only DataFrame functions.

Windows of every document are hashed in place, at each position from the hashes of one, two, four and more words, and
exploded as plain numbers onto the broadcast set; the words of a hit are compared before it counts. Only hits leave the
scan. They are keyed by the text's digest, so copies of a document bring the same hits, which collapse before they are
shuffled, and no row needs an id. A benchmark with more windows than may be broadcast is taken in several parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# --- fixed values: what parts words ---
PARTING = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# --- end of fixed values ---

WINDOW = 10
#: Windows that are broadcast at a time, and bytes of their words.
BROADCAST_WINDOWS = 400_000
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, f"[{PARTING}]+"), lambda w: w != "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_window_hashes(rows: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """Adds h1, h2, ... per size: the hash of every window of so many words of the column ``words``. Hashes of powers of
    two are columns of their own, so that none is evaluated again inside the next."""
    powers = [1 << k for k in range(max(sizes, default=1).bit_length())]
    out = rows.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(w)))
    for k in powers[1:]:
        half = F.col(f"_p{k // 2}")
        out = out.withColumn(f"_p{k}", F.zip_with(half, _from(half, k // 2), lambda a, b: F.xxhash64(a, b)))
    for size in sizes:
        at, whole = 0, None
        for k in reversed(powers):
            if size & k:
                part = _from(F.col(f"_p{k}"), at)
                whole = part if whole is None else F.zip_with(whole, part, lambda a, b: F.xxhash64(a, b))
                at += k
        # zip_with pads to the longer side: what reaches over the text's end is cut off
        out = out.withColumn(f"h{size}", F.slice(whole, 1, F.greatest(F.size(words) - size + 1, F.lit(0))))
    return out.drop(*[f"_p{k}" for k in powers])


def _from(values: Column, at: int) -> Column:
    return F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))) if at else values


def _size(n_words: Column, window: int) -> Column:
    return F.least(n_words, F.lit(window))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, h, words): the distinct windows of every item. ``size`` is ``window``, or the length of a shorter
    item. A NULL item_id stands as the empty string."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", _size(F.size("w"), window))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    cut = items.select("item_id", "size", "w", at.alias("at")).select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("v"))
    cut = cut.select("item_id", "size", "v", F.array_join("v", " ").alias("words")).distinct()
    sizes = list(range(1, window + 1))
    hashed = with_window_hashes(cut, "v", sizes)
    h = F.coalesce(*[F.when(F.col("size") == s, F.get(f"h{s}", F.lit(0))) for s in sizes])
    return hashed.select("item_id", "size", h.alias("h"), "words")


def _parts(windows: DataFrame, most: int, most_bytes: int) -> list[DataFrame]:
    """The distinct windows in parts that may be broadcast."""
    held = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first()
    n = max(1, -(-held["n"] // most), -(-held["b"] // most_bytes))
    return [windows.where(F.pmod("h", F.lit(n)) == k) if n > 1 else windows for k in range(n)]


def hits(docs: DataFrame, windows: DataFrame, most: int = BROADCAST_WINDOWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(digest, at, size, h, words): the occurrences in ``docs`` (digest, w) of stored, distinct ``windows`` (size, h, words).
    ``at`` counts words from 0."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most one per length of a window
    hashed = with_window_hashes(docs.select("digest", "w"), "w", sizes)
    found = []
    for part in _parts(windows, most, most_bytes):
        for size in sizes:
            sought = part.where(F.col("size") == size).select(F.col("h").alias("sought"), F.col("words").alias("told"))
            # the outer form: for the inner one Spark would filter by the array's size first, hashing all windows twice
            at = hashed.select("digest", "w", F.posexplode_outer(f"h{size}").alias("at", "h"))
            # between and not equal: an equality would become a join key, and every window's words would be joined
            here = F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ")
            met = at.join(F.broadcast(sought), (F.col("h") == F.col("sought")) & F.col("told").between(here, here))
            found.append(met.select("digest", "at", F.lit(size).alias("size"), "h", F.col("told").alias("words")))
    if not found:
        return docs.sparkSession.createDataFrame([], "digest binary, at int, size int, h bigint, words string")
    return reduce(DataFrame.unionByName, found).distinct()


def _spans(found: DataFrame) -> DataFrame:
    """Adds to every hit of a text the words (new_words) that no earlier hit covers."""
    order = Window.partitionBy("digest").orderBy("at", "size", "words")
    reached = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("at") + F.col("size")
    return found.withColumn("new_words", F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(reached, F.lit(0)))))


def judge(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text, anything
    else) against ``bench`` (item_id, text, anything else).

    Whole texts are compared. NULL and empty texts have no words: as documents they are clean, as items they occur
    nowhere. Items that share an id count once, and a NULL item_id counts as the empty string. Repeated rows and NULL
    doc_ids are judged like any other row. An empty benchmark leaves all rows clean; no documents give no rows."""
    windows = stored(benchmark_windows(bench, window), "windows")
    texts = docs.select("doc_id", F.col("text"))
    found = stored(_found(texts, windows), "hits")
    covered = _spans(found).groupBy("digest").agg(F.sum("new_words").cast("bigint").alias("n_hit"))
    items = found.select("digest", "size", "words").distinct().join(windows.select("item_id", "size", "words"), ["size", "words"])
    named = items.groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    told = covered.join(named, "digest").select(
        "digest", "n_hit", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")
    )
    n_words = F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")
    out = texts.select("doc_id", n_words, _digest(F.col("text")).alias("digest")).join(told, "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _found(texts: DataFrame, windows: DataFrame) -> DataFrame:
    worded = texts.select(_digest(F.col("text")).alias("digest"), words_of(F.col("text")).alias("w"))
    return hits(worded, windows.select("size", "h", "words").distinct())


def clean(docs: DataFrame, bench: DataFrame, how: str = "spans", window: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark holds, with their own columns.

    ``how="documents"`` drops rows with a hit. ``how="spans"`` keeps all rows and cuts hit words out of their texts, each
    with the characters behind it up to the next word; a text without a hit stays as it is, a NULL one too."""
    if how not in ("spans", "documents"):
        raise ValueError("how is 'spans' or 'documents'")
    own = "_contamination_"
    windows = stored(benchmark_windows(bench, window), "windows")
    found = stored(_found(docs.select("text"), windows), "hits")
    marked = docs.withColumn(f"{own}digest", _digest(F.col("text")))
    found = found.withColumnRenamed("digest", f"{own}digest")
    if how == "documents":
        return marked.join(found.select(f"{own}digest").distinct(), f"{own}digest", "left_anti").select(*docs.columns)
    # overlapping hits are one run of words
    order = Window.partitionBy(f"{own}digest").orderBy("at", "size", "words")
    end = F.col("at") + F.col("size")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("end", end).withColumn("opens", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(order)).groupBy(f"{own}digest", "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    cuts = runs.groupBy(f"{own}digest").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias(f"{own}cuts"))
    joined = marked.join(cuts, f"{own}digest", "left")
    # a word and what parts it from the next; what stands before the first word is kept
    pieces = F.regexp_extract_all("text", F.lit(f"([^{PARTING}]+[{PARTING}]*)"), F.lit(1))
    before = F.regexp_extract("text", f"^([{PARTING}]*)", 1)
    left = F.filter(pieces, lambda _, i: ~F.exists(f"{own}cuts", lambda c: (i >= c["at"]) & (i < c["end"])))
    text = F.when(F.col(f"{own}cuts").isNull(), F.col("text")).otherwise(F.concat(before, F.array_join(left, "")))
    return joined.withColumn("text", text).select(*docs.columns)
