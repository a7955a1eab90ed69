"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are added up per language and bucket by Spark; the log-probability matrix (buckets by languages, a fixed size
for a set of languages) is broadcast, and each text is scored from its sparse n-gram counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, fold

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Share of a language's texts below which its floor is measured, and n-grams that a text needs to be measured.
LOW = 0.005
LEAST_GRAMS = 200
#: Digits of a text's mean log likelihood that quantiles are taken from.
MEAN_DIGITS = 4
SLICE = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of a lower-cased text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    out, state = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        state = (state[: len(points) - n + 1] * STEP) + points[n - 1 :]
        if n in ORDERS:
            out.append(((state * STEP) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
            counts[lang] += np.bincount(buckets(text), minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray) -> None:
        self.languages, self.logs = languages, logs

    def totals(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihood of a text in each language, and its number of n-grams."""
        found = buckets(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), SLICE):
            total += self.logs[found[at : at + SLICE]].sum(axis=0, dtype=np.float64)
        return total, len(found)

    def score(self, text: str) -> tuple[str, float]:
        """Most probable language and its posterior with equal priors."""
        total, _ = self.totals(text)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def fits(self, text: str | None, least_score: float, floors: np.ndarray) -> bool:
        """Whether a text has a letter, one language that stands out, and is as likely in it, per n-gram, as texts of
        that language are."""
        if text is None or not any(map(str.isalpha, text)):
            return False
        total, n = self.totals(text)
        best = int(np.argmax(total))
        return bool(1 / np.exp(total - total[best]).sum() >= least_score and total[best] / n >= floors[best])


def _learnt(docs: DataFrame) -> DataFrame:
    """(lang, text) of every document whose fold is not 0."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    return usable.select("lang", "text")


def floors(docs: DataFrame, model: Model) -> np.ndarray:
    """For each language the least log likelihood per n-gram that a text may have. It lies as far below the low quantile
    of the texts that were learnt from as that lies below their median, so clean texts of other shapes pass as well."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        place = {x: i for i, x in enumerate(model.languages)}
        for rows in batches:
            mean = []
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                total, n = model.totals(text)
                mean.append(total[place[lang]] / n if n >= LEAST_GRAMS else None)
            yield pd.DataFrame({"lang": rows["lang"], "mean": mean}).dropna()

    scored = _learnt(docs).mapInPandas(run, "lang string, mean double")
    # quantiles of counted steps: a language has few of them, however many texts it has
    steps = scored.groupBy("lang", F.round("mean", MEAN_DIGITS).alias("mean")).agg(F.count(F.lit(1)).alias("n"))
    quantile = lambda share: F.percentile("mean", F.lit(share), F.col("n"))
    # at most two figures per language that the model holds
    found = steps.groupBy("lang").agg(quantile(LOW).alias("low"), quantile(0.5).alias("middle")).collect()
    least = {r["lang"]: 2 * r["low"] - r["middle"] for r in found}
    return np.array([least.get(x, -np.inf) for x in model.languages])


def fit(docs: DataFrame) -> Model | None:
    """Model from all documents with text and lang whose fold is not 0; None if there are none."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    learnt = _learnt(docs)
    counts = (
        learnt.mapInPandas(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    matrix[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(languages)})] += counts["n"]
    return Model(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score (names behind ``prefix``) from the whole text. A text that is NULL or has no
    letter gives ``und`` with score 0, and so does every text if nothing could be learnt."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [f"{prefix}lang_pred", f"{prefix}score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for rows in batches:
            found = [
                model.score(t) if model and t is not None and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t in rows["text"]
            ]
            rows[names[0]] = [x[0] for x in found]
            rows[names[1]] = np.array([x[1] for x in found], dtype=float)
            yield rows

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInPandas(run, ", ".join([*kinds, f"`{names[0]}` string", f"`{names[1]}` double"]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt from the other folds. A NULL doc_id is not held out
    and never learnt from. Repeated rows are scored alike; an empty table gives no rows."""
    model = fit(docs)
    # prediction sees the text alone; doc_id is carried past it
    scored = predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "lang_pred", "score")


def keep(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learnt: one that stands out with ``least_score``, and in
    which the text is not far less likely, per n-gram, than the language's own texts. Foreign scripts and strings of
    random letters fail that; texts that are NULL or have no letter are dropped, and so is everything if nothing could be
    learnt. Repeated rows are judged alike, an empty table gives none."""
    model = fit(docs)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast((model, floors(docs, model)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, least = shared.value
        for rows in batches:
            yield rows[[model.fits(t, least_score, least) for t in rows["text"]]]

    return docs.mapInPandas(run, docs.schema)
