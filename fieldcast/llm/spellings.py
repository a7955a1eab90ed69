"""Spelling variants by permuterm rotations.

Every word is written in all rotations of the word and an end mark. Words that differ by one replaced character have
rotations that agree up to their last character, which is the one replaced; a word with one character more has a rotation
that starts with a whole rotation of the shorter word. So both kinds of neighbours stand together once all rotations are
sorted by their prefixes: a group holds one shorter word at most and one longer word per character of the alphabet,
however many words there are. A scan of the groups hands each member its neighbours there.

Neighbours that an insertion parts would meet once per equal character in a row; only the first of such a run is skipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, forget, stored, stored_at

# --- fixed values: what a run of letters is, and which runs lose a letter ---
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP_EVERY = 97
# --- end of fixed values ---

LEAST_LETTERS = 5
LEAST_COUNT = 3
ROOT_FACTOR = 2
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Ends a word; no letter.
END = "$"

_LOWER = {b: b + 32 for b in range(65, 91)}


def observed(doc_id: str, text: str) -> Counter[str]:
    """Words of one text: lower-cased runs of letters, some of which lose a letter, as their checksum says."""
    out: Counter[str] = Counter()
    head = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), head)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counted(least_letters: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= least_letters]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(observed(doc_id, text))
                if len(held) >= HELD_WORDS:
                    yield flushed()
        yield flushed()

    return count


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with their occurrences, short and rare ones left out. A NULL doc_id is written
    as the empty string before the checksum's colon; a NULL text has no words."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = given.mapInArrow(_counted(least_letters), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, word, n): all rotations of each word and its end mark, without and with their last character,
    unless that is the mark. ``skipped`` is empty for the whole rotation."""
    n = F.length("word")
    turned = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(F.substr("marked", i), F.substr("marked", F.lit(1), i - 1)))
    every = words.withColumn("marked", F.concat("word", F.lit(END))).select("word", "n", F.explode(turned).alias("rotation"))
    last = F.substr("rotation", F.length("rotation"))
    cut = F.struct(F.substr("rotation", F.lit(1), F.length("rotation") - 1).alias("prefix"), last.alias("skipped"))
    whole = F.struct(F.col("rotation").alias("prefix"), F.lit("").alias("skipped"))
    forms = F.when(last == END, F.array(whole)).otherwise(F.array(whole, cut))
    return every.select("word", "n", F.explode(forms).alias("f")).select("f.prefix", "f.skipped", "word", "n")


def _scanned(words: DataFrame) -> DataFrame:
    """Every rotation with its group: rows of one prefix, the most frequent word first."""
    ranged = rotations(words).repartitionByRange("prefix")
    # prefixes that only one word has are most of them; they have no neighbour to tell of
    group = Window.partitionBy("prefix")
    first = F.substr("prefix", F.length("prefix")) != F.col("skipped")  # the first of equal characters in a row
    return ranged.withColumn("size", F.count("*").over(group)).where("size > 1").withColumns(
        {"shorter": F.col("skipped") == "", "first": F.coalesce(first, F.lit(True))}
    )


def _better(word: Column, n: Column) -> Column:
    """Sorts by falling n, then by code points; the least is the best."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def neighbour_totals(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words of ``words`` (word, n), and the one of largest n as a struct of -n
    and word. Words without one are left out. Groups are summed in place: no pair is emitted."""
    group = Window.partitionBy("prefix")
    order = group.orderBy("shorter", F.desc("n"), "word")
    longer = ~F.col("shorter")
    own = _better(F.col("word"), F.col("n"))
    scanned = _scanned(words).withColumns(
        {
            "n_longer": F.sum(longer.cast("int")).over(group),
            "n_first": F.sum((longer & F.col("first")).cast("int")).over(group),
            "best_first": F.min(F.when(longer & F.col("first"), own)).over(group),
            "best": F.min(F.when(longer, own)).over(group),
            "second": F.lead(F.when(longer, own)).over(order),
            "short_one": F.min(F.when(F.col("shorter"), own)).over(group),
        }
    )
    replaced = F.when(F.col("best.word") == F.col("word"), F.col("second")).otherwise(F.col("best"))
    inserted = F.when(F.col("first"), F.col("short_one"))
    n_near = F.when(F.col("shorter"), F.col("n_first")).otherwise(F.col("n_longer") - 1 + inserted.isNotNull().cast("int"))
    best = F.when(F.col("shorter"), F.col("best_first")).otherwise(F.least(replaced, inserted))
    told = scanned.select("word", n_near.cast("bigint").alias("n_near"), best.alias("best")).where("n_near > 0")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of near words. A word has at most one neighbour per place and letter of the
    alphabet; pairs are unique."""
    members = F.collect_list(F.struct("word", "shorter", "first")).over(Window.partitionBy("prefix"))
    grouped = _scanned(words).withColumn("members", members)
    pairs = grouped.select("word", "shorter", "first", F.explode("members").alias("o")).where(F.col("word") != F.col("o.word"))
    met = F.when(F.col("shorter"), F.col("o.first")).when(F.col("o.shorter"), F.col("first")).otherwise(F.lit(True))
    return pairs.where(met).select("word", F.col("o.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without cycles: the end of every chain. Each round doubles the length that is
    followed, so the rounds grow with the logarithm of the longest chain."""
    now, path = stored_at(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if not now.join(ahead, "root", "left_semi").limit(1).count():
            return now
        after, next_path = stored_at(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
        forget(now.sparkSession, path)
        now, path = after, next_path


def group_spellings(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = ROOT_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text, anything else) with at least
    ``least_letters`` letters and ``least_count`` occurrences.

    Near words differ by one inserted, deleted or replaced character. A word's form is its near word of largest n, the
    first by code points among equals, if that n is at least ``factor`` times its own; form and form_n are NULL
    otherwise. The root is reached by following forms, a word without form is its own. Repeated rows count again; texts
    without such a word, or an empty table, give no rows."""
    words = stored(word_counts(docs, least_letters, least_count), "words")
    near = neighbour_totals(words)
    wins = -F.col("best.minus") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", F.when(wins, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(wins, -F.col("best.minus")).alias("form_n"),
    )
    told = stored(joined, "forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
