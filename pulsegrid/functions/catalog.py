"""The vital-sign catalog and clinical score bands."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vital:
    field: str
    name: str
    loinc: str
    unit: str
    realtime: tuple[float, float]
    analytical: tuple[float, float]
    ordinal: bool = False


# Measurements with codes, units and ranges.
VITALS = (
    Vital("heart_rate", "heart_rate", "8867-4", "beats/minute", (20, 250), (20, 250)),
    Vital("respiratory_rate", "respiratory_rate", "9279-1", "breaths/minute", (4, 80), (4, 80)),
    Vital("spo2", "spo2", "2708-6", "%", (50, 100), (50, 100)),
    Vital("systolic_bp", "systolic_blood_pressure", "8480-6", "mmHg", (50, 300), (50, 260)),
    Vital("diastolic_bp", "diastolic_blood_pressure", "8462-4", "mmHg", (20, 200), (30, 180)),
    Vital("temperature", "body_temperature", "8310-5", "degrees Celsius", (30, 45), (32, 43)),
    Vital("inhaled_oxygen_concentration", "inhaled_oxygen_concentration", "3150-0", "%", (21, 100), (21, 100)),
    Vital("consciousness_level", "consciousness_level", "67775-7", "ACVPU ordinal", (0, 4), (0, 4), True),
)
BP_PANEL = "85354-9"
ACVPU = {"LA9340-6": 0, "LA6560-2": 1, "LA17108-4": 2, "LA17107-6": 3, "LA9343-0": 4}
ACVPU_LABELS = {0: "A", 1: "C", 2: "V", 3: "P", 4: "U"}
SCHEMA_VERSIONS = ("1.0", "1.1", "1.2")

# NEWS2 (Royal College of Physicians, 2017, SpO2 scale 1): upper bounds with scores, then the score above.
NEWS2_BANDS = {
    "respiratory_rate": (((8, 3), (11, 1), (20, 0), (24, 2)), 3),
    "spo2": (((91, 3), (93, 2), (95, 1)), 0),
    "inhaled_oxygen_concentration": (((21, 0),), 2),
    "systolic_bp": (((90, 3), (100, 2), (110, 1), (219, 0)), 3),
    "heart_rate": (((40, 3), (50, 1), (90, 0), (110, 1), (130, 2)), 3),
    "consciousness_level": (((0, 0),), 3),
    "temperature": (((35.0, 3), (36.0, 1), (38.0, 0), (39.0, 1)), 2),
}
NEWS2_VERSION = "news2-rcp-2017-spo2-scale-1"
LABEL_VERSION = "news2-repeated-extreme-proxy-v2"
FEATURE_VERSION = "vital-features-v3"
#: Values at or beyond which an outcome reading counts as extreme: (at most, at least).
EXTREMES = {"heart_rate": (40, 131), "respiratory_rate": (8, 25), "spo2": (91, None), "systolic_bp": (90, None)}

FIELDS = tuple(v.field for v in VITALS)
BY_FIELD = {v.field: v for v in VITALS}
BY_LOINC = {v.loinc: v for v in VITALS}
LOINC = {v.field: v.loinc for v in VITALS}

# Feature columns of the models, as (column, vital, statistic).
FEATURES = (
    ("heart_rate_mean", "heart_rate", "mean"),
    ("heart_rate_min", "heart_rate", "min"),
    ("heart_rate_max", "heart_rate", "max"),
    ("heart_rate_stddev", "heart_rate", "stddev"),
    ("respiratory_rate_mean", "respiratory_rate", "mean"),
    ("respiratory_rate_min", "respiratory_rate", "min"),
    ("respiratory_rate_max", "respiratory_rate", "max"),
    ("spo2_mean", "spo2", "mean"),
    ("spo2_min", "spo2", "min"),
    ("systolic_bp_mean", "systolic_bp", "mean"),
    ("systolic_bp_min", "systolic_bp", "min"),
    ("diastolic_bp_mean", "diastolic_bp", "mean"),
    ("temperature_mean", "temperature", "mean"),
    ("temperature_max", "temperature", "max"),
    ("inhaled_oxygen_concentration_max", "inhaled_oxygen_concentration", "max"),
    ("consciousness_level_max", "consciousness_level", "max"),
)
FEATURE_COLUMNS = tuple(f[0] for f in FEATURES)
MODEL_FEATURES = FEATURE_COLUMNS[:12]
MINUTE_FEATURES = tuple((f"{v}_{s}", v, s) for v, s in (*((v, "mean") for v in FIELDS[:6]), ("inhaled_oxygen_concentration", "max"), ("consciousness_level", "max")))
