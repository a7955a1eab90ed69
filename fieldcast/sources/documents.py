"""Forecast, history, current-conditions and alert documents (JSON text columns) to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .. import schemas as S


def _permissive(text: Column, schema) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


BAD = "_corrupt_record"
#: Measures are read as text, so that one wrong value is one wrong value and not a lost document.
HOURLY_TEXT = f"struct<{BAD}:string,hourly:struct<time:array<string>," + ",".join(f"{f}:array<string>" for f in S.HOURLY_FIELDS.values()) + ">>"


def _hourly(documents: DataFrame, text: str) -> tuple[list[str], DataFrame]:
    """The documents with their parsed form and whether it can be read: JSON of the expected shape with a list of hours."""
    kept = [c for c in documents.columns if c != text]
    parsed = F.from_json(F.col(text), HOURLY_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    whole = F.col(f"_d.{BAD}").isNull() & F.col("_d.hourly.time").isNotNull()
    return kept, documents.select("*", parsed.alias("_d")).withColumn("_whole", F.coalesce(whole, F.lit(False)))


def _opened_hours(documents: DataFrame, text: str) -> tuple[list[str], DataFrame]:
    """A row per hour of the readable documents: its place, its text, its measures as text, and whether all can be read."""
    kept, parsed = _hourly(documents, text)
    hours = parsed.filter("_whole").select(*kept, F.col("_d.hourly").alias("h"), F.posexplode("_d.hourly.time").alias("_pos", "_time"))
    values = {n: F.get(F.col(f"h.{f}"), F.col("_pos")) for n, f in S.HOURLY_FIELDS.items()}
    right = _hour_time().isNotNull()
    for v in values.values():
        right = right & (v.isNull() | v.try_cast("double").isNotNull())
    return kept, hours.select(*kept, "_pos", "_time", *[v.try_cast("double").alias(n) for n, v in values.items()], right.alias("_right"))


def _hour_time() -> Column:
    """The hour as wall-clock time, NULL if the text is none."""
    shape = F.col("_time").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$")
    return F.when(shape, F.col("_time").try_cast("timestamp_ntz"))


def unreadable(documents: DataFrame, text: str = "payload") -> DataFrame:
    """Quarantine of forecast documents: a row per document that is no JSON of the expected shape (``position`` NULL, its
    text) and per hour whose text is no time or that has a measure which is no number (its place and text), with the
    other columns of ``documents``. What is here is not in ``forecast_hours``, and the other way round."""
    kept, opened = _opened_hours(documents, text)
    hours = opened.filter("NOT _right").select(*kept, F.col("_pos").alias("position"), F.col("_time").alias("content"))
    broken = _hourly(documents, text)[1].filter("NOT _whole")
    return broken.select(*kept, F.lit(None).cast("int").alias("position"), F.col(text).alias("content")).unionByName(hours)


def forecast_hours(documents: DataFrame, text: str = "payload") -> DataFrame:
    """Parallel arrays of a document to one row per hour. A field the document lacks gives NULLs.

    Every other column of ``documents`` (site, fetch time) is kept. Hours that cannot be read, and documents that
    cannot, do not stop the others: ``unreadable`` lists them.
    """
    kept, opened = _opened_hours(documents, text)
    return opened.filter("_right").select(*kept, _hour_time().alias("time"), F.hour(_hour_time()).alias("hour"), *S.HOURLY_FIELDS)


def history_hours(documents: DataFrame, text: str = "payload") -> DataFrame:
    """History documents carry no rain probability."""
    return forecast_hours(documents, text).withColumn("precip_prob_pct", F.lit(None).cast("double"))


CURRENT_FIELDS = {n: f for n, f in S.HOURLY_FIELDS.items() if n != "precip_prob_pct"}
CURRENT_TEXT = f"struct<{BAD}:string,current:struct<" + ",".join(f"{f}:string" for f in CURRENT_FIELDS.values()) + ">>"


def _opened_current(documents: DataFrame, text: str) -> DataFrame:
    """The documents with their measures as text (``_c``) and whether all of it can be read."""
    parsed = F.from_json(F.col(text), CURRENT_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    right = F.col(f"_d.{BAD}").isNull() & F.col("_c").isNotNull()
    for f in CURRENT_FIELDS.values():
        right = right & (F.col(f"_c.{f}").isNull() | F.col(f"_c.{f}").try_cast("double").isNotNull())
    opened = documents.select("*", parsed.alias("_d")).withColumn("_c", F.col("_d.current"))
    return opened.withColumn("_right", F.coalesce(right, F.lit(False)))


def current_conditions(documents: DataFrame, text: str = "payload") -> DataFrame:
    """One row per readable document; measures that it lacks are NULL. ``unreadable_current`` lists the others, so a broken
    document is not taken for a silent station."""
    kept = [c for c in documents.columns if c != text]
    measures = [F.col(f"_c.{f}").try_cast("double").alias(n) for n, f in CURRENT_FIELDS.items()]
    return _opened_current(documents, text).filter("_right").select(*kept, *measures)


def unreadable_current(documents: DataFrame, text: str = "payload") -> DataFrame:
    """Quarantine of current conditions: the documents that are no JSON with a ``current`` object, or have a measure that is no
    number. ``position`` is NULL, as for every document that is set aside whole."""
    kept = [c for c in documents.columns if c != text]
    broken = _opened_current(documents, text).filter("NOT _right")
    return broken.select(*kept, F.lit(None).cast("int").alias("position"), F.col(text).alias("content"))


def split_bad_documents(documents: DataFrame, schema, text: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined): one broken document must not stop the others."""
    bad = "_corrupt_record"
    checked = F.from_json(
        F.col(text), schema.simpleString().replace("struct<", f"struct<{bad}:string,", 1),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad},
    )
    broken = F.coalesce(checked[bad].isNotNull(), F.lit(True)) | F.col(text).isNull()
    return documents.filter(~broken), documents.filter(broken)


def relevant(severity: Column, event: Column, headline: Column) -> Column:
    """Severe and extreme alerts always count; others need one of the words in event or headline."""
    text = F.lower(F.concat_ws(" ", F.coalesce(event, F.lit("")), F.coalesce(headline, F.lit(""))))
    return F.coalesce(severity.isin(*R.ALWAYS_RELEVANT), F.lit(False)) | text.rlike("|".join(R.ALERT_WORDS))


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; unknown severities come last."""
    place = F.array_position(F.lit(list(R.SEVERITY_ORDER)), F.coalesce(severity, F.lit("")))
    return F.when(place > 0, place - 1).otherwise(len(R.SEVERITY_ORDER)).cast("int")


def relevant_alerts(alerts: DataFrame, description_length: int = 300) -> DataFrame:
    """Keeps relevant alerts, shortens the description and adds ``severity_rank``; order by it and by
    the position of the feature at the sink."""
    c = F.col
    text = F.coalesce(c("description"), F.lit(""))
    return (
        alerts.filter(relevant(c("severity"), c("event"), c("headline")))
        .withColumn("description", F.substring(text, 1, description_length))
        .withColumn("severity_rank", severity_rank(c("severity")))
    )


ALERT_TEXT = f"struct<{BAD}:string,features:array<string>>"


def _alert_lists(documents: DataFrame, text: str) -> DataFrame:
    """The documents with the texts of their features, and whether there is such a list."""
    parsed = F.from_json(F.col(text), ALERT_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    whole = F.col(f"_d.{BAD}").isNull() & F.col("_d.features").isNotNull()
    return documents.select("*", parsed.alias("_d")).withColumn("_whole", F.coalesce(whole, F.lit(False)))


def _opened_features(documents: DataFrame, text: str) -> DataFrame:
    """A row per feature of the readable documents: its place, its text, its parsed form, and whether it is an object."""
    features = _alert_lists(documents, text).filter("_whole").select("*", F.posexplode("_d.features").alias("position", "content"))
    feature = S.ALERT_DOCUMENT["features"].dataType.elementType.simpleString().replace("struct<", f"struct<{BAD}:string,", 1)
    parsed = F.from_json("content", feature, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    right = F.col("f").isNotNull() & F.col(f"f.{BAD}").isNull() & F.ltrim("content").startswith("{")
    return features.withColumn("f", parsed).withColumn("_right", F.coalesce(right, F.lit(False)))


def alert_features(documents: DataFrame, text: str = "payload") -> DataFrame:
    """Alert documents to one row per feature, in document order. ``unreadable_alerts`` lists documents and features that
    cannot be read."""
    kept = [c for c in documents.columns if c != text]
    p = lambda n: F.col(f"f.properties.{n}")
    return _opened_features(documents, text).filter("_right").select(
        *kept, "position",
        F.coalesce(p("id"), F.lit("")).alias("alert_id"),
        *[p(n).alias(n) for n in ("event", "headline", "severity", "urgency")],
        p("areaDesc").alias("areas"),
        *[p(n).alias(n) for n in ("onset", "expires", "description")],
    )


def unreadable_alerts(documents: DataFrame, text: str = "payload") -> DataFrame:
    """Quarantine of alert documents: a row per document without a list of features (``position`` NULL, its text) and per
    feature that is no object of the expected shape (its place and text). An empty list is no fault."""
    kept = [c for c in documents.columns if c != text]
    broken = _alert_lists(documents, text).filter("NOT _whole")
    whole = broken.select(*kept, F.lit(None).cast("int").alias("position"), F.col(text).alias("content"))
    return whole.unionByName(_opened_features(documents, text).filter("NOT _right").select(*kept, "position", "content"))


#: Kind of document: how it is read, and what is set aside.
KINDS = {
    "forecast": (forecast_hours, unreadable),
    "current": (current_conditions, unreadable_current),
    "alerts": (alert_features, unreadable_alerts),
}
