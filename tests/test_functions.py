"""Column functions on edge values."""

from __future__ import annotations

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import BY_FIELD, NEWS2_BANDS, VITALS

#: The published chart, written as score -> closed intervals in the chart's own steps (whole numbers, tenths of a degree).
CHART = {
    "respiratory_rate": (1, {3: [(0, 8), (25, 70)], 2: [(21, 24)], 1: [(9, 11)], 0: [(12, 20)]}),
    "spo2": (1, {3: [(0, 91)], 2: [(92, 93)], 1: [(94, 95)], 0: [(96, 100)]}),
    "systolic_bp": (1, {3: [(0, 90), (220, 300)], 2: [(91, 100)], 1: [(101, 110)], 0: [(111, 219)]}),
    "heart_rate": (1, {3: [(0, 40), (131, 250)], 2: [(111, 130)], 1: [(41, 50), (91, 110)], 0: [(51, 90)]}),
    "temperature": (0.1, {3: [(20.0, 35.0)], 2: [(39.1, 45.0)], 1: [(35.1, 36.0), (38.1, 39.0)], 0: [(36.1, 38.0)]}),
}


def chart_cases():
    """Every interval's ends, and seeded values inside it, with the interval's score."""
    rng = random.Random(17)
    for parameter, (step, scores) in CHART.items():
        for score, intervals in scores.items():
            for low, high in intervals:
                inside = [low + step * rng.randrange(round((high - low) / step) + 1) for _ in range(4)]
                yield from ((parameter, round(x, 1), score) for x in (low, high, *inside))


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_news2_bands(spark):
    cases = list(chart_cases())
    got = one(spark, *(C.news2_score(p, F.lit(float(v))).alias(f"c{i}") for i, (p, v, _) in enumerate(cases)))
    assert [(c, g) for c, g in zip(cases, got, strict=True) if c[2] != g] == []
    # between two whole numbers a value counts with the next one up
    whole = lambda p, x: next(score for score, intervals in CHART[p][1].items() for low, high in intervals if low <= x <= high)
    between = [(p, x + 0.5, whole(p, x + 1)) for p in ("respiratory_rate", "spo2", "systolic_bp", "heart_rate") for x in random.Random(3).sample(range(5, 69), 25)]
    got = one(spark, *(C.news2_score(p, F.lit(float(v))).alias(f"c{i}") for i, (p, v, _) in enumerate(between)))
    assert [(c, g) for c, g in zip(between, got, strict=True) if c[2] != g] == []
    # oxygen counts from any supplement on, and consciousness from anything but alert on
    rest = [("inhaled_oxygen_concentration", 21.0 + x, 2 if x else 0) for x in (0, 0.5, 9, 79)] + [("consciousness_level", float(x), 3 if x else 0) for x in range(5)]
    assert list(one(spark, *(C.news2_score(p, F.lit(v)).alias(f"c{i}") for i, (p, v, _) in enumerate(rest)))) == [s for *_, s in rest]


def test_news2_total_and_band(spark):
    calm = {"respiratory_rate": 16, "spo2": 98, "inhaled_oxygen_concentration": 21, "systolic_bp": 120, "heart_rate": 70, "consciousness_level": 0, "temperature": 37}
    cases = [({}, 0, "low"), ({"spo2": 91}, 3, "low-medium"), ({"spo2": 91, "heart_rate": 115}, 5, "medium"), ({"spo2": 91, "heart_rate": 140, "temperature": 38.5}, 7, "high"), ({"spo2": None}, None, None)]
    for change, total, band in cases:
        v = {k: F.lit(None if x is None else float(x)).cast("double") for k, x in (calm | change).items()}
        got = one(spark, C.news2_total(v).alias("t"), C.news2_band(C.news2_total(v), [C.news2_score(p, v[p]) for p in NEWS2_BANDS]).alias("b"))
        assert got == (total, band), change


def test_warning_score_has_gaps_that_news2_has_not(spark):
    assert one(spark, C.warning_score("heart_rate", F.lit(90.5)).alias("a"), C.news2_score("heart_rate", F.lit(90.5)).alias("b")) == (0, 1)
    none = F.lit(None).cast("double")
    score, status = C.patient_priority({"heart_rate": F.lit(140.0), "spo2": none, "respiratory_rate": none, "systolic_bp": none})
    assert one(spark, score.alias("s"), status.alias("t")) == (3, "Urgent")
    score, status = C.patient_priority({"heart_rate": F.lit(95.0), "spo2": F.lit(float("nan")), "respiratory_rate": none, "systolic_bp": none})
    assert one(spark, score.alias("s"), status.alias("t")) == (1, "Review")
    score, status = C.patient_priority(dict.fromkeys(("heart_rate", "spo2", "respiratory_rate", "systolic_bp"), none))
    assert one(spark, score.alias("s"), status.alias("t")) == (-1, "No data")


@pytest.mark.parametrize(("text", "want"), [("2024-01-01T00:00:00", 1704067200), ("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01T02:00:00+02:00", 1704067200), ("nope", None), ("", None)])
def test_iso_times(spark, text, want):
    assert one(spark, F.unix_timestamp(C.parse_iso(F.lit(text)))) == want


def test_keys_and_text(spark):
    got = one(
        spark, C.stable_key(F.lit("x")).alias("a"), C.composite_key(F.lit("a"), F.lit("b")).alias("b"), C.composite_key(F.lit("a"), F.lit(None)).alias("c"), C.id_tail(F.lit("Patient/7")).alias("d"),
        C.reference_id(F.lit("Patient/x"), "Patient").alias("e"), C.reference_id(F.lit("Group/x"), "Patient").alias("f"), C.reference_id(F.lit("Patient/"), "Patient").alias("g"), C.hex_prefix_number(F.lit("00000ff0"), 7).alias("h"),
        C.truthy(F.lit(" Yes ")).alias("i"), C.truthy(F.lit("2")).alias("j"), C.valid_npi(F.lit("1203899566")).alias("k"), C.valid_npi(F.lit("1203899567")).alias("l"), C.npi_check_digit(F.lit("120389956")).alias("m"),
    )
    assert got == (hashlib.md5(b"x").hexdigest(), hashlib.md5(b"a|b").hexdigest(), None, "7", "x", None, None, 255, True, False, True, False, 6)
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("enc:1", "é", ""):
        assert one(spark, C.uuid5(space, F.lit(name))) == str(uuid.uuid5(uuid.UUID(space), name))
    labels = one(spark, *(C.probability_label(F.lit(p).cast("double")).alias(f"p{i}") for i, p in enumerate((None, 0.0, 0.0004, 0.1234, 1.0))))
    assert labels == ("--", "0.0%", "<0.1%", "12.3%", "100.0%")


def test_glob_patterns(spark):
    cases = [("abc", "a*", True), ("abc", "a?c", True), ("abc", "A*", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("x+y", "x+*", True), ("", "*", True)]
    assert one(spark, *(C.glob_match(F.lit(x), F.lit(p)).alias(f"c{i}") for i, (x, p, _) in enumerate(cases))) == tuple(w for *_, w in cases)


def test_numbers(spark):
    def unit(key):
        return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")

    assert one(spark, C.unit_interval(F.lit("k"))) == pytest.approx(unit("k") / 2**64, rel=1e-12)
    assert one(spark, C.seeded_index(F.lit("seed:p1"), 3)) == unit("seed:p1") % 3
    got = one(spark, *(C.reflect(F.lit(float(x)), 50, 100, (20, 250)).alias(f"c{i}") for i, x in enumerate((70, 45, 104, 160, 255))))
    assert got == (70.0, 55.0, 96.0, 60.0, 255.0)
    got = one(spark, *(C.shift_clamped(F.lit(float(x)), F.lit(float(o)), (50, 100)).alias(f"c{i}") for i, (x, o) in enumerate(((95, 3), (99, 3), (40, 20), (95, 0)))))
    assert got == (98.0, 100.0, 40.0, 95.0)
    assert one(spark, *(C.ramp(F.lit(float(t)), 300, 600, 900).alias(f"c{i}") for i, t in enumerate((0, 300, 450, 700, 900)))) == (0.0, 0.0, 0.5, 1.0, 0.0)
    assert one(spark, C.whole_div(F.lit(7201).cast("long"), 3600).alias("a"), C.whole_div(F.lit(-1).cast("long"), 60).alias("b")) == (2, 0)
    old = one(spark, *(C.age_at_least(F.lit(b).cast("date"), F.lit("2024-02-28").cast("date"), 65).alias(f"c{i}") for i, b in enumerate(("1959-02-28", "1959-03-01", "1950-01-01"))))
    assert old == (True, False, True)
    assert one(spark, *(C.freshness_status(F.lit(x).cast("double"), 10, 60).alias(f"c{i}") for i, x in enumerate((None, 10, 11, 61)))) == ("No data", "Current", "Delayed", "Stale")


def test_reading_key_sorts_by_time(spark):
    t = F.lit("2024-01-02 03:04:05.000006").cast("timestamp")
    assert one(spark, C.reading_key(t, F.lit("o1"))) == "2024-01-02T03:04:05.000006Z#o1"


def test_catalog():
    assert len(VITALS) == 8 and BY_FIELD["systolic_bp"].realtime == (50, 300) and BY_FIELD["systolic_bp"].analytical == (50, 260)
