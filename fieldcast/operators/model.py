"""Viability model: logistic regression on standardised daily measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["temp_max_f", "temp_min_f", "temp_range", "precip_in", "wind_max_mph"]
EPSILON = 1e-8


def training_rows(daily: DataFrame) -> DataFrame:
    needed = ["temp_max_f", "temp_min_f", "precip_in", "pour_score"]
    return daily.dropna(subset=needed)


def features(rows: DataFrame) -> DataFrame:
    """Feature columns as doubles and the label "was a green day". Unknown wind counts as calm."""
    high, low = F.col("temp_max_f").cast("double"), F.col("temp_min_f").cast("double")
    return rows.select(
        "station_id",
        "observation_date",
        high.alias("temp_max_f"),
        low.alias("temp_min_f"),
        (high - low).alias("temp_range"),
        F.col("precip_in").cast("double").alias("precip_in"),
        F.coalesce(F.col("wind_max_mph").cast("double"), F.lit(0.0)).alias("wind_max_mph"),
        (F.col("pour_score") == "green").cast("double").alias("label"),
    )


def moments(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature: one aggregate row."""
    row = rows.agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]
    ).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in FEATURES}


def standardise(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    scaled = {f: (F.col(f) - F.lit(m)) / F.lit(s + EPSILON) for f, (m, s) in stats.items()}
    return rows.withColumns({f"z_{f}": c for f, c in scaled.items()})


def split_in_order(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: exactly the first ``share`` of the rows by date and station.

    Counts per date tell the one date in which the share ends; only its rows are put in order, all others stay where
    they lie. Rows without a date count but are left out.
    """
    day = F.col("observation_date")
    counts = rows.groupBy("observation_date").agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.agg(F.floor(F.sum("n") * F.lit(share)).alias("n")).scalar()
    # one row per calendar date
    upto = counts.filter(day.isNotNull()).withColumn("upto", F.sum("n").over(Window.orderBy("observation_date")))
    last = upto.filter(F.col("upto") > wanted).orderBy("observation_date").select(
        "observation_date", (wanted - F.col("upto") + F.col("n")).alias("rest")
    ).first()
    if last is None:
        return rows.filter(day.isNotNull()).withColumn("is_train", F.lit(True))
    date, rest = F.lit(last["observation_date"]), last["rest"]
    place = F.row_number().over(Window.partitionBy("observation_date").orderBy("station_id"))
    return rows.filter(day != date).withColumn("is_train", day < date).unionByName(
        rows.filter(day == date).withColumn("is_train", place <= rest)
    )


@dataclass
class ViabilityModel:
    stats: dict[str, tuple[float, float]]
    fitted: LogisticRegressionModel

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``probability_green`` and ``predicted`` (at 0.5)."""
        scored = self.fitted.transform(_assemble(standardise(rows, self.stats)))
        probability = vector_to_array(F.col("probability"))[1]
        return scored.select(
            *rows.columns,
            probability.alias("probability_green"),
            (probability >= 0.5).cast("double").alias("predicted"),
        )

    def importance(self) -> list[tuple[str, float]]:
        weights = zip(FEATURES, [abs(float(w)) for w in self.fitted.coefficients])
        return sorted(weights, key=lambda x: -x[1])


def _assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol="features").transform(rows)


def train(rows: DataFrame, iterations: int = 200, l2: float = 1e-3) -> ViabilityModel:
    """Fits on the given rows. Rain nearly separates the label, so a small L2 keeps the weights finite."""
    stats = moments(rows)
    estimator = LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=iterations, regParam=l2,
        elasticNetParam=0.0, standardization=False,
    )
    return ViabilityModel(stats, estimator.fit(_assemble(standardise(rows, stats))))


def report(fitted: ViabilityModel, scored: DataFrame) -> DataFrame:
    """section, name, n, value: rows and accuracy per split, rows and share per label, and the features by weight, ``n`` being
    the rank. ``scored`` has ``is_train``."""
    line = lambda section, name, n, value: [
        F.lit(section).alias("section"), name.alias("name"), n.cast("bigint").alias("n"), value.cast("double").alias("value")
    ]
    c = F.col
    splits = accuracy(scored).select(*line("accuracy", F.when(c("is_train"), "train").otherwise("test"), c("n"), c("accuracy")))
    green = F.when(c("label") == 1, "green").otherwise("not green")
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    labels = scored.groupBy(green.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    labels = labels.select(*line("label", c("kind"), c("n"), c("n") / total.scalar()))
    ranked = [("importance", name, rank, weight) for rank, (name, weight) in enumerate(fitted.importance(), 1)]
    weights = scored.sparkSession.createDataFrame(ranked, "section string, name string, n bigint, value double")
    return splits.unionByName(labels).unionByName(weights)


def accuracy(scored: DataFrame) -> DataFrame:
    hit = F.avg((F.col("predicted") == F.col("label")).cast("double"))
    return scored.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), hit.alias("accuracy"))
