"""Grading thresholds and the fixed word lists.

Fixed values: they have to equal the published decision rules, so they stand here together, in the
order in which the rules name them.
"""

# Severity of a verdict; the worst factor decides, so "worst of" is a plain max.
GREEN, YELLOW, RED = 1, 2, 3
VERDICTS = ("green", "yellow", "red")

# Working day, end hour exclusive.
WORK_START_HOUR = 7
WORK_END_HOUR = 17

# Hours shown in detail; later days are planning only.
DETAIL_HOURS = 48

# Air temperature, °F.
TEMP_GREEN_LOW, TEMP_GREEN_HIGH = 50, 90
TEMP_YELLOW_LOW, TEMP_YELLOW_HIGH = 40, 95

# Relative humidity for a pour, percent.
POUR_HUMIDITY_GREEN_LOW, POUR_HUMIDITY_GREEN_HIGH = 25, 70
POUR_HUMIDITY_YELLOW_LOW, POUR_HUMIDITY_YELLOW_HIGH = 15, 85

# Relative humidity for sealer, percent (exclusive).
SEALER_HUMIDITY_GREEN, SEALER_HUMIDITY_YELLOW = 70, 85

# Sustained wind, mph (exclusive).
POUR_WIND_GREEN, POUR_WIND_YELLOW = 10, 20
SEALER_WIND_GREEN, SEALER_WIND_YELLOW = 10, 15
CURE_WIND_GREEN, CURE_WIND_YELLOW = 15, 25
CURE_GUST_GREEN, CURE_GUST_YELLOW = 25, 35

# Chance of rain, percent (exclusive).
POUR_PROB_GREEN, POUR_PROB_YELLOW = 15, 40
SEALER_PROB_GREEN, SEALER_PROB_YELLOW = 10, 40
CURE_PROB_GREEN, CURE_PROB_YELLOW = 15, 40

# Rain amounts, inches (exclusive).
DAILY_POUR_RAIN_YELLOW = "0.10"
DAILY_SEALER_RAIN_YELLOW = "0.05"
TRACE_RAIN = "0.005"
WET_RAIN = "0.1"

# Air temperature minus dew point, °F (exclusive).
SPREAD_GREEN, SPREAD_YELLOW = 10, 5

# Coverage that makes a 24-hour or 12-hour reading trustworthy.
HISTORY_MIN_ROWS, HISTORY_MAX_UNKNOWN = 20, 2
PROB_MIN_ROWS = 20
CURE_TEMP_MIN_ROWS = 10

# Factor order for reasons.
FACTOR_ORDER = ("precipitation", "temperature", "wind", "humidity", "dewpoint", "data")

# Station file elements and first year kept.
ELEMENTS = ("TMAX", "TMIN", "PRCP", "SNOW", "SNWD", "AWND", "WSF2", "WSF5")
FIRST_YEAR = 2021

# Alerts: severities that always pass, words that let the rest pass, sort order.
ALWAYS_RELEVANT = ("Extreme", "Severe")
ALERT_WORDS = (
    "freeze", "frost", "wind", "thunder", "hail", "flood", "ice", "tornado", "heat",
    "storm", "snow", "blizzard", "winter", "rain", "hurricane",
)
SEVERITY_ORDER = ("Extreme", "Severe", "Moderate", "Minor")
ALERT_TTL_SECONDS = 86400

# Freshness limits of a snapshot, in minutes.
SNAPSHOT_TTL_MINUTES = {"forecast": 60, "history": 30, "alerts": 5}

# Stored snapshots live one hour and are dropped seven days after that.
SNAPSHOT_LIFE_HOURS = 1
RETENTION_DAYS = 7

# Season: day-of-year band.
SEASON_FIRST_DOY, SEASON_LAST_DOY = 60, 340
