"""Phrase collocations from sorted count streams, as external language-model estimation lays them out.

Only the highest order is counted from texts: every position gives the phrase of up to three words that starts there.
Tasks count blocks of text in memory and hand on sorted runs; one range exchange puts all runs in prefix order. A scan of
that stream adds up every order at once, because all phrases that start with the same words stand together. The counts
that pass the threshold are then kept as streams by their first words (prefix order) and by their last words (suffix
order), and sort-merge joins walk them in step for the count of the first part, the count of the rest, and the largest
extension on either side. No count is looked up in a hash table and nothing is broadcast.

A range partition holds an even share of the distinct phrases whatever word they begin with, so a very frequent word or
pair is no single task's; what a partition knows only partly, its first and last beginnings, is added up afterwards.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, stored

# --- fixed values: what parts pieces and words ---
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
# --- end of fixed values ---

ORDER = 3
LEAST = 10
TOP = 2_000
INSIDE_PERCENT = 50
#: Bytes of text that a task counts in memory before it hands on a run, and words of one text that it takes at a time.
BLOCK_BYTES = 24 << 20
BLOCK_WORDS = (1 << 21) - 4
RUN_ROWS = 1 << 16
RANK_SHARES = 64
BITS = 21
#: Texts, and distinct phrases of theirs, that the ranges of the stream are cut by, at most (about).
SAMPLE_TEXTS = 4_000
SAMPLE_KEYS = 32_000
#: Stands between the parts of a stream key. It sorts before every word byte, for words are escaped.
SEP = b"\x00"
BREAK = b"."

_TABLE = bytes(ord(BREAK) if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def escape(word: bytes) -> bytes:
    """Free of zero bytes, in the same order."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


def unescape(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01") if b"\x01" in word else word


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; ``BREAK``, which no word can hold, stands between pieces."""
    # bytes.split() parts at the ASCII white space; of that only blank and tab are left here
    return text.translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split()


def _runs(lang: bytes, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sorted counts of the phrases that start at each word; phrases end at a break."""
    for at in range(0, len(words), BLOCK_WORDS):
        here = words[at : at + BLOCK_WORDS + ORDER - 1]  # looks ahead into the next block
        coded = pa.array(here, pa.binary()).dictionary_encode()
        vocabulary = [*map(escape, coded.dictionary.to_pylist())]
        by_bytes = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
        place = np.zeros(len(vocabulary), np.int64)
        place[by_bytes] = np.arange(1, len(vocabulary) + 1)
        place[[i for i, w in enumerate(vocabulary) if w == BREAK]] = 0
        ids = place[coded.indices.to_numpy()]
        code = ids << (BITS * (ORDER - 1))
        open_ = ids > 0
        for n in range(1, ORDER):
            after = np.concatenate([ids, np.zeros(n, np.int64)])[n:]
            open_ = open_ & (after > 0)
            code += np.where(open_, after, 0) << (BITS * (ORDER - 1 - n))
        code, count = np.unique(code[:BLOCK_WORDS][ids[:BLOCK_WORDS] > 0], return_counts=True)
        words_in_order = pa.array([None, *(vocabulary[i] for i in by_bytes)], pa.binary())
        for lo in range(0, len(code), RUN_ROWS):
            part = code[lo : lo + RUN_ROWS]
            places = [(part >> (BITS * (ORDER - 1 - n))) & ((1 << BITS) - 1) for n in range(ORDER)]
            columns = [words_in_order.take(pa.array(p)) for p in places]
            key = pc.binary_join_element_wise(pa.scalar(lang, pa.binary()), *columns, pa.scalar(SEP, pa.binary()), null_handling="skip")
            yield pa.RecordBatch.from_arrays([key, pa.array(count[lo : lo + RUN_ROWS], pa.int64())], names=["gram", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: dict[bytes, list[bytes]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block.setdefault(lang, []).append(text)
            held += len(text)
            if held >= BLOCK_BYTES:
                yield from _flushed(block)
                block, held = {}, 0
    yield from _flushed(block)


def _flushed(block: dict[bytes, list[bytes]]) -> Iterator[pa.RecordBatch]:
    for lang, texts in block.items():
        yield from _runs(escape(lang), words_of(BREAK.join(texts)))


def _dealt(bounds: list[bytes]):
    """Counts blocks and adds to each phrase the range it falls in; runs are sorted, so every range is a slice."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _count(batches):
            keys = run.column(0)
            places = range(len(keys))
            ends = [bisect.bisect_left(places, b, key=lambda i: keys[i].as_py()) for b in bounds]  # noqa: B023
            part = np.repeat(np.arange(len(bounds) + 1, dtype=np.int32), np.diff([0, *ends, len(keys)]))
            yield pa.RecordBatch.from_arrays([*run.columns, pa.array(part, pa.int32())], names=["gram", "n", "part"])

    return deal


def _parts_of(grams: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Language and words of stream keys as columns (NULL beyond a key's last word), and the number of parts."""
    split = pc.split_pattern(grams, SEP)
    at = split.offsets.to_numpy()[: len(grams) + 1]
    sizes = np.diff(at)
    columns = [split.values.take(pa.array(at[:-1] + k, mask=sizes <= k)) for k in range(ORDER + 1)]
    return columns, sizes


def _scanner(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of every beginning (language, one word, two words, phrase) from a partition in prefix order. A count
        below the threshold is dropped once it is known to be whole: full phrases always are, a shorter beginning is if
        it neither opens nor closes the partition. Totals of languages are handed on whatever they are."""
        last: pa.Array | None = None  # the key before, and what its beginnings have gathered
        held, opens = [0] * (ORDER + 1), [True] * (ORDER + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, n = batch.column(0), batch.column(1).to_numpy()
            if last is not None:  # the key before stands in front, with no count of its own
                grams, n = pa.concat_arrays([last, grams]), np.append(0, n)
            parts, sizes = _parts_of(grams)
            differs = np.zeros(len(n) - 1, bool)
            rows, counts, levels = [], [], []
            for k in range(ORDER + 1):
                same = pc.equal(parts[k][1:], parts[k][:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                differs = differs | ~(same | (sizes[1:] <= k) & (sizes[:-1] <= k))
                starts = np.append(0, np.flatnonzero(differs) + 1)
                total = np.add.reduceat(n, starts)
                total[0] += held[k]
                keep = (total >= least) | (k == 0)
                keep[0] |= opens[k] and k < ORDER
                keep[-1] = False  # goes on, perhaps
                keep &= sizes[starts] > k
                rows.append(starts[keep]), counts.append(total[keep]), levels.append(np.full(keep.sum(), k))
                held[k], opens[k] = int(total[-1]), opens[k] and len(starts) == 1
            last = grams[-1:]
            yield _as_columns(parts, np.concatenate(rows), np.concatenate(counts), np.concatenate(levels))
        if last is not None:
            parts, sizes = _parts_of(last)
            ends = [k for k in range(ORDER + 1) if sizes[0] > k and (k < ORDER or held[k] >= least)]
            yield _as_columns(parts, np.zeros(len(ends), int), np.array([held[k] for k in ends]), np.array(ends))

    return scan


def _as_columns(parts: list[pa.Array], rows: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
    columns = []
    for k, part in enumerate(parts):
        words = part.take(pa.array(rows, mask=levels < k))
        columns.append(pa.array([w if w is None else unescape(w) for w in words.to_pylist()], pa.binary()))
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*PARTS, "n"])


PARTS = ["lang", *(f"w{k}" for k in range(1, ORDER + 1))]


def _bounds(given: DataFrame, parts: int) -> list[bytes]:
    """Keys that cut the stream into ``parts`` ranges of like numbers of rows, from the phrases of a bounded sample of
    texts. They decide where a phrase is counted, never whether."""
    rows = given.count()
    if not rows or parts < 2:
        return []
    sample = given if rows <= SAMPLE_TEXTS else given.sample(SAMPLE_TEXTS / rows, 7)
    grams = sample.mapInArrow(_count, "gram binary, n bigint").select("gram", F.xxhash64("gram").alias("h"))
    # the least hashes of each share: tasks and the driver take no more than SAMPLE_KEYS keys, however long texts are
    place = F.row_number().over(Window.partitionBy(F.pmod("h", F.lit(RANK_SHARES))).orderBy("h"))
    chosen = sorted(bytes(r["gram"]) for r in grams.withColumn("k", place).where(F.col("k") <= SAMPLE_KEYS // RANK_SHARES).select("gram").collect())
    return sorted({chosen[len(chosen) * i // parts] for i in range(1, parts)}) if chosen else []


def count_streams(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, n): every phrase of one to three words with n >= ``least``, missing words NULL, and for each
    language a row without words whose n counts all its words."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    given = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = given.mapInArrow(_dealt(_bounds(given, parts)), "gram binary, n bigint, part int")
    # every key has one range, so equal phrases meet; the ranges are in order, and so is each one after the sort
    stream = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("gram").select("gram", "n")
    parts = stream.mapInArrow(_scanner(least), ", ".join(f"{p} binary" for p in PARTS) + ", n bigint")
    whole = parts.groupBy(*[F.col(p).cast("string").alias(p) for p in PARTS]).agg(F.sum("n").alias("n"))
    return whole.where((F.col("n") >= least) | F.col("w1").isNull())


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Both sides in the order of ``on``, walked in step."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def candidates(streams: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words in stored ``streams`` that no longer phrase
    explains. l and r belong to the cut with the least score."""
    one = streams.where("w1 IS NOT NULL AND w2 IS NULL")
    two = streams.where("w2 IS NOT NULL AND w3 IS NULL").drop("w3")
    three = streams.where("w3 IS NOT NULL")
    # prefix order: the count of the first word, and the most frequent extension to the right
    two = _merged(two, one.select("lang", "w1", F.col("n").alias("l")), ["lang", "w1"])
    right = three.groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer_right"))
    two = _merged(two, right, ["lang", "w1", "w2"], "left")
    # suffix order: the count of the last word, and the most frequent extension to the left
    two = _merged(two, one.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r")), ["lang", "w2"])
    left = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("n").alias("longer_left"))
    two = stored(_merged(two, left, ["lang", "w1", "w2"], "left"), "pairs")
    heads = two.select("lang", "w1", "w2", F.col("n").alias("l_head"), F.col("l").alias("l_first"))
    tails = two.select(
        "lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("r_tail"), F.col("r").alias("r_last")
    )
    three = _merged(_merged(three, heads, ["lang", "w1", "w2"]), tails, ["lang", "w2", "w3"])
    first, second = score("n", "l_first", "r_tail"), score("n", "l_head", "r_last")
    late = second < first
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
        F.when(late, F.col("l_head")).otherwise(F.col("l_first")).alias("l"),
        F.when(late, F.col("r_last")).otherwise(F.col("r_tail")).alias("r"),
        F.least(first, second).alias("score"),
    )
    longer = F.coalesce(F.greatest("longer_left", "longer_right"), F.lit(0))  # greatest() skips NULLs
    alone = two.where(100 * longer < inside_percent * F.col("n"))
    pairs = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), "l", "r", score("n", "l", "r").alias("score"))
    return pairs.unionByName(three)


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    wide = [F.col(c).cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (text, lang, anything
    else).

    Phrases of two or three words within a piece count if they occur ``least`` times or more. The score is that of the
    phrase's worst cut. A phrase is dropped if a longer one that counts holds it and reaches ``inside_percent`` of its
    count. Order: score, then a, both descending, then the phrase by its bytes, so there are no ties. NULL texts are
    empty; a NULL language is ``und``, as one of that name is. Repeated rows count again. Texts without a word, or an
    empty table, give no rows."""
    streams = stored(count_streams(docs, least), "streams")
    totals = streams.where("w1 IS NULL").select("lang", F.col("n"))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rank = lambda *group: F.row_number().over(Window.partitionBy(*group).orderBy(*best)).cast("bigint")
    # ranked in shares first, so that a language's last ranking takes no more rows however many phrases it has
    share = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES))
    first = candidates(streams, inside_percent).withColumn("share", share).withColumn("rank", rank("lang", "share")).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
