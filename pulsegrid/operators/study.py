"""The study's analysis frames, grouped moderators, out-of-fold scores and hypothesis tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import FEATURE_COLUMNS
from pulsegrid.operators import stats
from pulsegrid.operators.features import SLOPES
from pulsegrid.operators.ranking import forward_fill

# Groups of admitting diagnoses and attending specialties, the first of each the reference level.
DIAGNOSES = {
    "Cardiovascular": ("22298006", "401303003", "401314000", "88805009", "49436004", "132281000119108"),
    "Respiratory": ("233604007", "840539006", "389087006", "65710008", "195951007", "185086009", "87433001"),
    "Infection and shock": ("91302008", "770349000", "76571007", "27942005", "45816000", "128045006", "312157006"),
}
SPECIALTIES = {
    "Critical care and pulmonary": ("207RC0200X", "207RP1001X"),
    "Cardiology": ("207RC0000X",),
    "Hospital and internal medicine": ("208M00000X", "207R00000X"),
    "Other": ("207RI0200X", "207RN0300X", "208600000X"),
}
MODERATORS = ("age_65_plus", "diagnosis_group", "specialty_group")
VITALS = ("heart_rate", "respiratory_rate", "spo2", "systolic_bp", "temperature", "inhaled_oxygen_concentration", "consciousness_level")
PREDICTION_VITALS = VITALS[:5]
FIVE_MINUTE = ("systolic_bp", "temperature", "inhaled_oxygen_concentration", "consciousness_level")
SCORING_MINUTE = 14


def _grouped(code: Column, groups: dict[str, tuple[str, ...]], other: Column) -> Column:
    return F.coalesce(C.lookup({c: g for g, codes in groups.items() for c in codes}, code), other)


def diagnosis_group(code: Column, admitting: list[str] | None = None) -> Column:
    """The group of an admitting diagnosis; raises at run time for a code that is not on the admitting list."""
    wrong = F.raise_error(F.concat(F.lit("diagnosis is not on the admitting list: "), F.coalesce(code, F.lit("null")))).cast("string")
    return _grouped(code, DIAGNOSES, F.lit("Other") if admitting is None else F.when(code.isin(admitting), "Other").otherwise(wrong))


def specialty_group(code: Column) -> Column:
    """The group of an attending's specialty; raises at run time for an unknown code."""
    return _grouped(code, SPECIALTIES, F.raise_error(F.concat(F.lit("specialty is not in the plan's groups: "), F.coalesce(code, F.lit("null")))).cast("string"))


def encounter_frame(training: DataFrame, news2: DataFrame, trends: DataFrame, admissions: DataFrame, split_groups: DataFrame) -> DataFrame:
    """Training encounters with their NEWS2, slopes, admission and split group: four inner joins on keys."""
    groups = split_groups.select(C.stable_key(F.col("patient_id")).alias("patient_key"), "split_group")
    rows = training.select("encounter_key", "patient_key", F.col("deterioration_proxy_label").alias("label"), "data_split", *FEATURE_COLUMNS)
    rows = rows.join(news2.select("encounter_key", "news2_total"), "encounter_key").join(trends.select("encounter_key", *(f"{v}_slope" for v in SLOPES)), "encounter_key")
    rows = rows.join(admissions.select("encounter_key", "age_at_admission_years", "diagnosis_code", "attending_taxonomy_code"), "encounter_key")
    return rows.join(groups, "patient_key")


def analysis_set(encounters: DataFrame, admitting: list[str] | None = None) -> DataFrame:
    """Encounters with a complete NEWS2 and the three moderators."""
    return encounters.where("news2_total is not null").withColumns(
        {"age_65_plus": (F.col("age_at_admission_years") >= 65).cast("int"), "diagnosis_group": diagnosis_group(F.col("diagnosis_code"), admitting), "specialty_group": specialty_group(F.col("attending_taxonomy_code"))}
    )


def minute_frame(minutes: DataFrame, encounters: DataFrame) -> DataFrame:
    """Minute rows of the analysis set under the vitals' names; vitals taken every five minutes are carried forward."""
    names = {**{f"{v}_mean": v for v in VITALS[:5]}, **{f"{v}_max": v for v in VITALS[5:]}}
    rows = minutes.select("encounter_key", "minute_index", *(F.col(c).alias(v) for c, v in names.items()))
    filled = forward_fill(rows, "encounter_key", "minute_index", list(FIVE_MINUTE))
    return filled.join(encounters.select("encounter_key", "split_group", "label", *MODERATORS), "encounter_key")


def out_of_fold_scores(minutes: DataFrame, folds: DataFrame, vitals: tuple[str, ...] = PREDICTION_VITALS, scoring_minute: int = SCORING_MINUTE) -> DataFrame:
    """(encounter_key, split_group, label, fold, naive_logistic, gee_logistic): each scored by models of the other folds.

    Both models share one design; an encounter's score is its prediction in the scoring minute.
    """
    dealt = minutes.join(folds, "split_group")
    out = None
    for fold in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        train, test = dealt.where(F.col("fold") != fold), dealt.where((F.col("fold") == fold) & (F.col("minute_index") == scoring_minute))
        design, _ = stats.minute_design(train, list(vitals))
        naive = stats.logistic_fit(train, design, F.col("label"))
        clustered = stats.gee(train, design, F.col("label"), "encounter_key").beta
        p = lambda beta: 1.0 / (1.0 + F.exp(-stats.linear(design, beta)))  # noqa: B023, E731
        scored = test.select("encounter_key", "split_group", "label", "fold", p(naive).alias("naive_logistic"), p(clustered).alias("gee_logistic"))
        out = scored if out is None else out.unionByName(scored)
    return out


@dataclass(frozen=True)
class JointTest:
    statistic: float
    degrees_of_freedom: int
    p_value: float
    holm_p_value: float | None = None


def vital_signal_test(minutes: DataFrame, cluster: str = "split_group", vitals: tuple[str, ...] = VITALS) -> JointTest:
    """The generalised score test of all vital terms against a model of the minute alone."""
    design, _ = stats.minute_design(minutes, list(vitals))
    k = len(vitals)
    null, extra = [design[0], design[1 + k]], [*design[1 : 1 + k], *design[2 + k :]]
    return JointTest(*stats.score_test(minutes, null, extra, F.col("label"), cluster))


def _dummies(moderator: str, frame: DataFrame) -> list[Column]:
    levels = {"age_65_plus": (0, 1), "diagnosis_group": (*DIAGNOSES, "Other"), "specialty_group": tuple(SPECIALTIES)}[moderator]
    present = {r[0] for r in frame.select(moderator).distinct().collect()}  # the levels, at most four
    return [(F.col(moderator) == level).cast("double") for level in levels[1:] if level in present]


def moderation_tests(minutes: DataFrame, cluster: str = "split_group", moderators: tuple[str, ...] = MODERATORS) -> dict[str, JointTest]:
    """For each moderator, whether it changes the label's effect on the heart rate's trend; adjusted by Holm."""
    rows = minutes.where("heart_rate is not null")
    t, y = F.col("minute_index").cast("double"), F.col("label").cast("double")
    raw = {}
    for m in moderators:
        d = _dummies(m, rows)
        k = len(d)
        design = [F.lit(1.0), t, y, *d, t * y, *(x * t for x in d), *(x * y for x in d), *(x * t * y for x in d)]
        fit = stats.gee(rows, design, F.col("heart_rate"), cluster, binomial=False, bias_reduced=True)
        raw[m] = stats.wald(fit, list(range(4 + 3 * k, 4 + 4 * k)))
    return _adjusted(raw)


def rise_moderation_tests(minutes: DataFrame, cluster: str = "split_group", moderators: tuple[str, ...] = MODERATORS) -> dict[str, JointTest]:
    """The same on the rise of the heart rate over the window, one row for each encounter."""
    rows = stats.heart_rate_rise(minutes, [cluster, "label", *moderators])
    y = F.col("label").cast("double")
    raw = {}
    for m in moderators:
        d = _dummies(m, rows)
        fit = stats.gee(rows, [F.lit(1.0), y, *d, *(x * y for x in d)], F.col("rise"), cluster, binomial=False, bias_reduced=True)
        raw[m] = stats.wald(fit, list(range(2 + len(d), 2 + 2 * len(d))))
    return _adjusted(raw)


def _adjusted(raw: dict[str, tuple[float, int, float]]) -> dict[str, JointTest]:
    return {m: JointTest(*t, p) for (m, t), p in zip(raw.items(), stats.holm([t[2] for t in raw.values()]), strict=True)}


#: The scales of trend and events over which a calibration runs.
TREND_SCALES, EVENT_SCALES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25), (0.6, 0.8, 1.0, 1.2, 1.4)


def calibration_grid(scored: DataFrame, label: str = "label") -> DataFrame:
    """(trend_scale, event_scale, model, news2): the two AUCs at each point of a grid, from rows scored at every point.

    All points are ranked in one job, as groups.
    """
    point = ["trend_scale", "event_scale"]
    one = lambda score: stats.auc_frame(scored, label, score, point).select(*point, F.col("auc").alias(score))
    return one("model").join(one("news2"), point)


def calibration_choice(grid: DataFrame, model: float = 0.80, news2: float = 0.70) -> DataFrame:
    """The row of a grid (trend_scale, event_scale, model, news2) whose two AUCs are nearest to the targets."""
    d = F.sqrt(F.pow(F.col("model") - model, 2) + F.pow(F.col("news2") - news2, 2))
    return grid.withColumn("distance", d).orderBy("distance", "trend_scale", "event_scale").limit(1)


def power(p_values: list[float], alpha: float = 0.05) -> float:
    """The share of runs whose test is below alpha."""
    return sum(p < alpha for p in p_values) / len(p_values) if p_values else math.nan
