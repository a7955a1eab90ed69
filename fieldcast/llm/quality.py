"""Quality rules with verdicts per host: failures are added up by domain, rates are shrunk with a beta prior that is
estimated from all domains, and the domains' verdicts are joined back to the documents. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# --- fixed values: the base rules ---
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = r" \t\n\x0B\f\r"
# --- end of fixed values ---

#: A host is rejected when its shrunk failure rate is above this: most of what it serves fails.
HOST_RATE = 0.5
#: Bounds of the prior's strength in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0


def _split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _with_windows(out: DataFrame, words: str, name: str) -> DataFrame:
    """Replaces the words by the hash of every window of eight, from hashes of one, two, four and eight words. Each
    level is a column of its own, so that none is evaluated again inside the next."""
    h = F.col(name)
    out = out.withColumn(name, F.when(F.size(words) > REPEAT_WINDOW, F.transform(words, lambda w: F.xxhash64(w)))).drop(words)
    step = 1
    while step < REPEAT_WINDOW:
        shifted = F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        out = out.withColumn(name, F.zip_with(h, shifted, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    # zip_with pads to the longer side: the last windows are short ones and are cut off
    return out.withColumn(name, F.slice(h, 1, F.greatest(F.size(h) - REPEAT_WINDOW + 1, F.lit(0))))


def measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, each name behind
    ``prefix``. Whole texts are measured; a NULL text has no words. Windows are compared by 64-bit hashes of their
    words within one text."""
    p = lambda n: f"{prefix}{n}"
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    out = docs.withColumns(
        {
            p("words"): _split_words(text),
            p("lines"): lines,
            p("n_symbols"): (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        }
    )
    words = F.col(p("words"))
    out = out.withColumns(
        {
            p("n_words"): F.size(words).cast("bigint"),
            p("word_chars"): F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("bigint"),
            p("n_dup_lines"): (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("bigint"),
        }
    )
    out = _with_windows(out.drop(p("lines")), p("words"), p("windows"))
    found = F.col(p("windows"))
    placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(p("placed"), F.when(F.size(F.array_distinct(found)) < F.size(found), placed)).drop(p("windows"))
    at = F.col(p("placed"))
    same = lambda x, i: (F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"])
    hits = F.transform(at, lambda x, i: F.when(F.coalesce(same(x, i), F.lit(False)), x["i"]))
    out = out.withColumn(p("hits"), F.array_sort(F.filter(hits, lambda x: x.isNotNull()))).drop(p("placed"))
    starts = F.col(p("hits"))
    # each window covers its words up to the next window's start, eight at most
    covered = F.transform(starts, lambda x, i: F.coalesce(F.least(F.get(starts, i + 1) - x, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint")
    out = out.withColumn(p("n_repeat_words"), total).drop(p("hits"))
    failed = (F.col(p("n_words")) < LEAST_WORDS) | (100 * F.col(p("n_repeat_words")) > MOST_REPEATED_PERCENT * F.col(p("n_words")))
    return out.withColumn(p("base_failed"), failed)


def host_rates(measured: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, host_rate): failure rates shrunk to the common mean. The beta prior's strength is the
    moment estimate over all hosts, weighted by their documents. NULL is a host of its own."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed")
    )
    total, bad, n = F.sum("n_docs"), F.sum("n_failed"), F.count("*")
    squares = F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs"))
    one = hosts.agg(total.alias("total"), bad.alias("bad"), n.alias("n"), squares.alias("squares")).first()
    mean, strength = prior(one["total"] or 0, one["bad"] or 0, one["n"], one["squares"] or 0.0)
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"))


def prior(total: int, bad: int, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and strength of the beta prior from four totals: documents, failures, hosts, and failures squared by
    documents."""
    if not total:
        return 0.0, LEAST_STRENGTH
    mean = bad / total
    spread = mean * (1 - mean)
    between = squares / total - mean * mean
    left = spread * (1 - hosts / total)
    overlap = (between - spread * hosts / total) / left if left > 0 else 1.0
    if overlap <= 0:
        return mean, MOST_STRENGTH
    return mean, min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / overlap - 1))


def judge(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """doc_id, the measures, host_rate and kept for every row of ``docs``. A document stays if it passes the base
    rules and its host's shrunk failure rate is at most ``host_rate``. NULL and empty texts have no words and fail; a
    NULL host is a host of its own; texts are measured whole; repeated rows each count and are each returned; a rate that
    equals ``host_rate`` stays; other columns are ignored; an empty table gives none."""
    measured = stored(measures(docs.select("doc_id", host, "text")).drop("text"), "measures")
    rates = host_rates(measured, host, "base_failed").select(F.col("host").alias("_host"), "host_rate")
    joined = measured.join(rates, F.col(host).eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_rate))


def keep(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. The measured rows are stored once with their texts,
    so no key is needed to find the documents again. Rows are decided as by ``judge``; columns may bear any name that does
    not begin with ``_quality_``."""
    columns = docs.columns
    own = "_quality_"
    measured = measures(docs, own).select(*columns, f"{own}base_failed")
    measured = stored(measured, "measured")
    rates = host_rates(measured, host, f"{own}base_failed").where(F.col("host_rate") > host_rate)
    # stored, so its size is known when the join is planned: while it is small, no document is shuffled by its host
    rejected = stored(rates.select(F.col("host").alias(f"{own}host")), "rejected_hosts")
    passed = measured.where(~F.col(f"{own}base_failed"))
    return passed.join(rejected, F.col(host).eqNullSafe(F.col(f"{own}host")), "left_anti").select(*columns)
