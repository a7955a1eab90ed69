"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

_d = T.DecimalType


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_FACTORS = T.MapType(T.StringType(), T.StringType())

STATIONS = _struct(
    station_id=T.StringType(), name=T.StringType(), covers=T.StringType(), state=T.StringType(),
    latitude=_d(7, 4), longitude=_d(7, 4), elevation_m=_d(6, 1),
)

DAILY = _struct(
    station_id=T.StringType(), observation_date=T.DateType(),
    temp_max_f=_d(5, 1), temp_min_f=_d(5, 1), temp_mean_f=_d(5, 1), precip_in=_d(5, 2),
    snow_in=_d(5, 1), snow_depth_in=_d(5, 1), wind_avg_mph=_d(5, 1), wind_max_mph=_d(5, 1),
    pour_score=T.StringType(), sealer_score=T.StringType(),
    score_details=_struct(pour=_FACTORS, sealer=_FACTORS),
)

JOBS = _struct(
    job_id=T.LongType(), start_date=T.DateType(), completion_date=T.DateType(), final_revenue=_d(10, 2),
    month=T.StringType(), lead_name=T.StringType(), address=T.StringType(), job_type=T.StringType(),
    concrete_type=T.StringType(), lead_status=T.StringType(), square_footage=T.IntegerType(),
    concrete_company=T.StringType(), sealer_coats=T.IntegerType(), admixture_type=T.StringType(),
    station_id=T.StringType(),
)

# Hourly measures in payload order: column name -> field of the forecast document.
HOURLY_FIELDS = {
    "temp_f": "temperature_2m",
    "humidity_pct": "relative_humidity_2m",
    "dewpoint_f": "dew_point_2m",
    "precip_prob_pct": "precipitation_probability",
    "precip_in": "precipitation",
    "wind_mph": "wind_speed_10m",
    "wind_gust_mph": "wind_gusts_10m",
    "cloud_cover_pct": "cloud_cover",
}

HOURLY_DOCUMENT = _struct(
    hourly=_struct(
        time=T.ArrayType(T.StringType()),
        **{f: T.ArrayType(T.DoubleType()) for f in HOURLY_FIELDS.values()},
    )
)

CURRENT_DOCUMENT = _struct(
    current=_struct(**{f: T.DoubleType() for n, f in HOURLY_FIELDS.items() if n != "precip_prob_pct"})
)

ALERT_PROPERTIES = _struct(
    id=T.StringType(), event=T.StringType(), headline=T.StringType(), severity=T.StringType(),
    urgency=T.StringType(), areaDesc=T.StringType(), onset=T.StringType(), expires=T.StringType(),
    description=T.StringType(),
)

ALERT_DOCUMENT = _struct(features=T.ArrayType(_struct(properties=ALERT_PROPERTIES)))

SNAPSHOTS = _struct(
    station_id=T.StringType(), forecast_hour=T.TimestampNTZType(),
    temp_f=T.DoubleType(), humidity_pct=T.DoubleType(), wind_mph=T.DoubleType(), wind_gust_mph=T.DoubleType(),
    precip_prob_pct=T.DoubleType(), precip_amount_in=T.DoubleType(), dewpoint_f=T.DoubleType(),
    cloud_cover_pct=T.DoubleType(), pour_score=T.StringType(), score_factors=_FACTORS,
    fetched_at=T.TimestampType(), expires_at=T.TimestampType(), fetched_date=T.DateType(),
)
