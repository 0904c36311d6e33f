"""Column functions: keys, text checks, times and scores. Each takes and gives Columns and stays in codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.catalog import NEWS2_BANDS

# ---- keys and text ----


def stable_key(x: Column) -> Column:
    """Lowercase hex MD5 of the text."""
    return F.md5(x.cast("string"))


def composite_key(*parts: Column) -> Column:
    """MD5 of the parts joined by a bar; null where any part is null."""
    joined = [parts[0].cast("string")]
    for p in parts[1:]:
        joined += [F.lit("|"), p.cast("string")]
    return F.md5(F.concat(*joined))


def is_blank(x: Column) -> Column:
    """Whether the text is null or white space."""
    return x.isNull() | (F.length(F.trim(x)) == 0)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def id_tail(x: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(x, "/", -1)


def reference_id(x: Column, kind: str) -> Column:
    """The id of a reference such as Patient/x; null for another prefix or an empty id."""
    return F.nullif(F.regexp_extract(x, f"^{kind}/(.+)$", 1), F.lit(""))


def hex_prefix_number(key: Column, digits: int) -> Column:
    """The first hex digits of a key as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes")


def valid_npi(x: Column) -> Column:
    """Ten digits whose Luhn sum, after the prefix 80840, holds."""
    return F.coalesce(x.rlike("^[0-9]{10}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), x)), F.lit(False))


def npi_check_digit(first_nine: Column) -> Column:
    """The digit that completes nine digits to a valid number."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.substring(F.reverse(F.concat(F.lit("80840"), first_nine)), i + 1, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, d: a + d
    )
    return F.pmod(10 - total % 10, F.lit(10))


def probability_label(p: Column) -> Column:
    small = (p > 0) & (p < 0.001)
    shown = F.concat(F.format_string("%.1f", F.round(p * 100, 1)), F.lit("%"))
    return F.when(p.isNull() | F.isnan(p), F.lit("--")).when(small, F.lit("<0.1%")).otherwise(shown)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The name-based UUID, version 5, as the SHA-1 of the namespace's bytes and the name with version bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def lookup(mapping: Mapping, x: Column) -> Column:
    """The mapped value; null where there is none."""
    return F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair))[x]


def loinc_code(concept: Column) -> Column:
    """The first LOINC coding's code of a codeable concept."""
    found = F.filter(concept["coding"], lambda c: c["system"] == "http://loinc.org")
    return F.try_element_at(found, F.lit(1))["code"]


def glob_match(x: Column, pattern: Column) -> Column:
    """Whether the whole text matches a shell pattern of *, ? and literal characters."""
    quoted = F.regexp_replace(pattern, r"([.^$+(){}|\\\[\]])", r"\\$1")
    return F.rlike(x, F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def valid_identifier(x: Column) -> Column:
    """Whether a text is a plain SQL identifier."""
    return F.coalesce(x.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def valid_model_version(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))


# ---- times ----


def parse_iso(text: Column) -> Column:
    """ISO-8601 text as a timestamp, naive text in the session's zone (UTC); null where it cannot be read."""
    return text.try_cast("timestamp")


def date_key(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd").cast("int")


def calendar(day: Column) -> dict[str, Column]:
    """The columns of a calendar dimension."""
    return {
        "calendar_year": F.year(day),
        "calendar_quarter": F.quarter(day),
        "month_number": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "day_of_month": F.dayofmonth(day),
        "iso_day_of_week": F.extract(F.lit("DOW_ISO"), day),
        "day_name": F.date_format(day, "EEEE"),
        "iso_week_of_year": F.weekofyear(day),
    }


def add_minutes(t: Column, minutes: Column | int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes), t)


def add_hours(t: Column, hours: Column | int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours), t)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, truncated."""
    return F.timestamp_diff("SECOND", start, end)


def whole_div(x: Column, n: int) -> Column:
    """Integer division, truncated towards zero."""
    return F.call_function("div", x, F.lit(n).cast("long"))


def age_years(birth: Column, at: Column) -> Column:
    """Whole years of 31,557,600 seconds."""
    return whole_div(seconds_between(birth.cast("timestamp"), at), 31557600)


def age_at_least(birth: Column, at: Column, years: int) -> Column:
    """Whether the calendar age on a day reaches so many years."""
    before = F.struct(F.month(at), F.dayofmonth(at)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(at) - F.year(birth) - before.cast("int") >= years


def epoch_ms(t: Column) -> Column:
    return F.unix_millis(t)


def latency_ms(event: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(event)) / 1000.0, F.lit(0.0))


def reading_key(t: Column, observation_id: Column) -> Column:
    """Event time and id as text that sorts by time."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("#"), observation_id)


# ---- numbers ----


def unit_interval(key: Column) -> Column:
    """A number in [0, 1) from the first eight bytes of the key's SHA-256."""
    return sha_number(key).cast("double") / F.lit(float(2**64))


def sha_number(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_index(key: Column, n: int) -> Column:
    return F.pmod(sha_number(key), F.lit(n).cast("decimal(20,0)")).cast("int")


def reflect(x: Column, low: float, high: float, accepted: tuple[float, float]) -> Column:
    """The value folded into [low, high] at its ends; one outside the accepted range stays."""
    span = float(high - low)
    offset = F.pmod(x - low, F.lit(2 * span))
    folded = F.round(low + F.when(offset <= span, offset).otherwise(2 * span - offset), 1)
    return F.when(x.between(*accepted), folded).otherwise(x)


def shift_clamped(x: Column, offset: Column, accepted: tuple[float, float]) -> Column:
    """The value moved and kept in range; one outside it stays, and null stays null."""
    moved = F.least(F.greatest(x + offset, F.lit(float(accepted[0]))), F.lit(float(accepted[1])))
    return F.when(x.isNull() | (offset == 0) | ~x.between(*accepted), x).otherwise(moved)


def ramp(elapsed: Column, start: float, end: float, until: float) -> Column:
    """0 before start and from until on, else the share of the way to end, 1 at most."""
    return F.when((elapsed < start) | (elapsed >= until), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (elapsed - start) / float(end - start)))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def to_number(text: Column) -> Column:
    """Text as a double, NaN where it is missing or blank."""
    return F.when(is_blank(text.cast("string")), F.lit(float("nan"))).otherwise(text.try_cast("double"))


def logistic(features: list[Column], medians, means, scales, coefficients, intercept: float) -> Column:
    """The probability of a median-imputed, standardised linear model."""
    logit = F.lit(float(intercept))
    for x, median, mean, scale, c in zip(features, medians, means, scales, coefficients, strict=True):
        value = F.coalesce(finite(x.cast("double")), F.lit(float(median)))
        logit = logit + F.lit(float(c)) * (value - F.lit(float(mean))) / F.lit(float(scale))
    return 1.0 / (1.0 + F.exp(-logit))


# ---- scores and bands ----


def news2_score(parameter: str, x: Column) -> Column:
    """The parameter's NEWS2 score; null without a value."""
    bands, above = NEWS2_BANDS[parameter]
    found = F.when(x.isNull(), F.lit(None).cast("int"))
    for bound, score in bands:
        found = found.when(x <= bound if parameter != "consciousness_level" else x == bound, F.lit(score))
    return found.otherwise(F.lit(above))


def news2_total(values: Mapping[str, Column]) -> Column:
    """The sum of all seven scores; null where one is missing."""
    scores = [news2_score(p, values[p]) for p in NEWS2_BANDS]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total


def news2_band(total: Column, scores: list[Column]) -> Column:
    return F.when(total.isNull(), F.lit(None)).when(total >= 7, "high").when(total >= 5, "medium").when(F.greatest(*scores) == 3, "low-medium").otherwise("low")


def range_status(x: Column, low: float, high: float) -> Column:
    """Low, Normal or High; Unknown without a value."""
    return F.when(x.isNull(), "Unknown").when(x < low, "Low").when(x > high, "High").otherwise("Normal")


def heart_rate_status(x: Column) -> Column:
    return range_status(x, 60, 100)


def respiratory_rate_status(x: Column) -> Column:
    return range_status(x, 12, 20)


def spo2_status(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").when(x < 90, "Critical").when(x < 95, "Low").otherwise("Normal")


def temperature_status(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").when(x <= 35.0, "Low").when(x >= 38.1, "Fever").otherwise("Normal")


def oxygen_status(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").when(x <= 21, "Room air").otherwise("Supplemental")


def warning_score(field: str, x: Column) -> Column:
    """The dashboard's parameter score. Its bands leave gaps between whole numbers, unlike NEWS2."""
    x = finite(x.cast("double"))
    none = F.when(x.isNull(), F.lit(None).cast("int"))
    if field == "heart_rate":
        bands = none.when((x <= 40) | (x >= 131), 3).when(x.between(111, 130), 2).when(x.between(41, 50) | x.between(91, 110), 1)
    elif field == "spo2":
        bands = none.when(x <= 91, 3).when(x <= 93, 2).when(x <= 95, 1)
    elif field == "respiratory_rate":
        bands = none.when((x <= 8) | (x >= 25), 3).when(x.between(21, 24), 2).when(x.between(9, 11), 1)
    elif field == "systolic_bp":
        bands = none.when((x <= 90) | (x >= 220), 3).when(x <= 100, 2).when(x <= 110, 1)
    else:
        bands = none
    return bands.otherwise(0)


def patient_priority(values: Mapping[str, Column]) -> tuple[Column, Column]:
    """(score, status) of the dashboard's four parameters."""
    fields = ("heart_rate", "spo2", "respiratory_rate", "systolic_bp")
    present = [values[f].isNotNull().cast("int") for f in fields]
    scores = [warning_score(f, values[f]) for f in fields]
    total = sum((F.coalesce(s, F.lit(0)) for s in scores[1:]), F.coalesce(scores[0], F.lit(0)))
    valid = sum((s.isNotNull().cast("int") for s in scores[1:]), scores[0].isNotNull().cast("int"))
    shown = sum(present[1:], present[0])
    urgent = (total >= 7) | F.greatest(*(F.coalesce(s, F.lit(0)) for s in scores)).eqNullSafe(3)
    review = (valid != shown) | (total > 0)
    score = F.when(shown == 0, -1).when(urgent, total).when(review, F.greatest(total, F.lit(1))).otherwise(0)
    return score, F.when(shown == 0, "No data").when(urgent, "Urgent").when(review, "Review").otherwise("Stable")


def freshness_status(age: Column, fresh: float, delayed: float) -> Column:
    return F.when(age.isNull(), "No data").when(age <= fresh, "Current").when(age <= delayed, "Delayed").otherwise("Stale")
