"""Encounter features, labels, minute panels, trends, NEWS2, unit census and model datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import EngineConfig
from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import EXTREMES, FEATURE_COLUMNS, FEATURE_VERSION, FEATURES, LABEL_VERSION, LOINC, MINUTE_FEATURES, NEWS2_BANDS, NEWS2_VERSION

STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp}
SLOPES = ("heart_rate", "respiratory_rate", "spo2", "systolic_bp", "temperature")


def _now(config: EngineConfig) -> Column:
    return F.lit(config.as_of).cast("timestamp") if config.as_of else F.current_timestamp()


def encounter_vital_features(encounters: DataFrame, facts: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Features of the first window and the label of the second, in one aggregation over the joined facts.

    The cutoff belongs to the outcome window. Windows are anchored at each encounter's start, so rows past the
    outcome window are filtered before the shuffle.
    """
    config = config or EngineConfig()
    keys = ["encounter_key", "patient_key", "provider_key", "provider_version_key", "encounter_start_at", "encounter_end_at"]
    windows = encounters.select(
        *keys,
        C.add_minutes(F.col("encounter_start_at"), config.feature_minutes).alias("feature_cutoff_at"),
        C.add_minutes(F.col("encounter_start_at"), config.feature_minutes + config.outcome_minutes).alias("outcome_cutoff_at"),
    )
    rows = windows.join(facts.select("encounter_key", "loinc_code", "value", "effective_datetime"), "encounter_key")
    in_feature = F.col("effective_datetime") < F.col("feature_cutoff_at")
    in_outcome = (F.col("effective_datetime") >= F.col("feature_cutoff_at")) & (F.col("effective_datetime") < F.col("outcome_cutoff_at"))
    rows = rows.withColumns({"_f": in_feature, "_o": in_outcome})

    def of(vital: str) -> Column:
        return F.when(F.col("_f") & (F.col("loinc_code") == LOINC[vital]), F.col("value"))

    def extreme(vital: str) -> Column:
        low, high = EXTREMES[vital]
        beyond = F.col("value") <= low if high is None else (F.col("value") <= low) | (F.col("value") >= high)
        return F.count_if(F.col("_o") & (F.col("loinc_code") == LOINC[vital]) & beyond)

    found = rows.groupBy(*keys, "feature_cutoff_at", "outcome_cutoff_at").agg(
        F.count_if("_f").alias("feature_observation_count"),
        F.count_if("_o").alias("outcome_observation_count"),
        *(STATISTICS[s](of(v)).alias(n) for n, v, s in FEATURES),
        *(extreme(v).alias(f"outcome_{v}_extreme_count") for v in EXTREMES),
    )
    label = (F.greatest(*(F.col(f"outcome_{v}_extreme_count") for v in EXTREMES)) >= config.min_repeated_extremes).cast("int")
    now = _now(config)
    return found.withColumns(
        {
            "feature_window_seconds": C.seconds_between(F.col("encounter_start_at"), F.col("feature_cutoff_at")),
            "deterioration_proxy_label": label,
            "label_definition_version": F.lit(LABEL_VERSION),
            "is_scoring_eligible": (now >= F.col("feature_cutoff_at")) & (F.col("feature_observation_count") > 0),
            "is_training_eligible": (now >= F.col("outcome_cutoff_at")) & (F.col("feature_observation_count") > 0) & (F.col("outcome_observation_count") > 0),
        }
    )


def minute_features(features: DataFrame, facts: DataFrame) -> DataFrame:
    """Means and maxima for each minute of the feature window of training encounters."""
    eligible = features.where("is_training_eligible").select("encounter_key", "patient_key", "deterioration_proxy_label", "encounter_start_at", "feature_cutoff_at")
    rows = eligible.join(facts.select("encounter_key", "loinc_code", "value", "effective_datetime"), "encounter_key").where("effective_datetime < feature_cutoff_at")
    minute = F.floor(C.whole_div(C.seconds_between(F.col("encounter_start_at"), F.col("effective_datetime")), 60)).cast("int")
    keys = ["encounter_key", "patient_key", "minute_index", "deterioration_proxy_label"]
    found = (
        rows.withColumn("minute_index", minute)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("observation_count"), *(STATISTICS[s](F.when(F.col("loinc_code") == LOINC[v], F.col("value"))).alias(n) for n, v, s in MINUTE_FEATURES))
    )
    return found.select(C.composite_key(F.col("encounter_key"), F.col("minute_index")).alias("encounter_minute_key"), *found.columns)


def trend_features(minutes: DataFrame) -> DataFrame:
    """Least-squares slopes of minute means over minutes; null for a single minute."""
    keys = ["encounter_key", "patient_key", "deterioration_proxy_label"]
    return minutes.groupBy(*keys).agg(*(F.regr_slope(F.col(f"{v}_mean"), F.col("minute_index").cast("double")).alias(f"{v}_slope") for v in SLOPES))


def encounter_news2(features: DataFrame, facts: DataFrame) -> DataFrame:
    """NEWS2 from the last value of each parameter before the cutoff; no total where one is missing.

    The last value is max_by over (time, key), which aggregates before the shuffle, not a window.
    """
    keys = ["encounter_key", "patient_key", "feature_cutoff_at"]
    rows = features.select(*keys).join(facts.select("encounter_key", "fact_observation_key", "loinc_code", "value", "effective_datetime"), "encounter_key").where("effective_datetime < feature_cutoff_at")

    def last(vital: str) -> Column:
        hit = F.when(F.col("loinc_code") == LOINC[vital], F.struct("effective_datetime", "fact_observation_key"))
        return F.max_by("value", hit)

    found = rows.groupBy(*keys).agg(*(last(p).alias(p) for p in NEWS2_BANDS))
    values = {p: F.col(p) for p in NEWS2_BANDS}
    names = {"inhaled_oxygen_concentration": "inhaled_oxygen_score", "consciousness_level": "consciousness_score"}
    return found.select(
        "encounter_key", "patient_key", F.col("feature_cutoff_at").alias("scored_at"), *NEWS2_BANDS,
        *(C.news2_score(p, values[p]).alias(names.get(p, f"{p}_score")) for p in NEWS2_BANDS),
        F.lit(NEWS2_VERSION).alias("news2_version"),
        C.news2_total(values).alias("news2_total"),
    )


def unit_hourly_census(admissions: DataFrame, news2: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Patients present in each unit and hour, with admissions, discharges and acuity.

    Each stay is exploded into its hours, which needs no join with a table of hours; at most max_stay_hours,
    and only hours that start before the discharge.
    """
    config = config or EngineConfig()
    rows = admissions.select("encounter_key", "unit_key", "facility_key", "unit", "admitted_at", "discharged_at").join(news2.select("encounter_key", "news2_total"), "encounter_key", "left")
    first = F.date_trunc("HOUR", "admitted_at")
    rows = rows.withColumn("first_hour", first).where("first_hour < discharged_at")
    last = F.least(F.date_trunc("HOUR", "discharged_at"), C.add_hours(F.col("first_hour"), config.max_stay_hours - 1))
    hours = rows.withColumn("hour_start", F.explode(F.sequence("first_hour", last, F.expr("interval 1 hour")))).where("hour_start < discharged_at")
    end = C.add_hours(F.col("hour_start"), 1)
    found = hours.groupBy("unit_key", "facility_key", "unit", "hour_start").agg(
        F.count(F.lit(1)).alias("census"),
        F.count_if((F.col("admitted_at") >= F.col("hour_start")) & (F.col("admitted_at") < end)).alias("admissions"),
        F.count_if((F.col("discharged_at") >= F.col("hour_start")) & (F.col("discharged_at") < end)).alias("discharges"),
        F.avg("news2_total").alias("mean_admission_news2"),
        F.count_if(F.col("news2_total") >= 5).alias("patients_news2_5_or_more"),
        F.count_if(F.col("news2_total") >= 7).alias("patients_news2_7_or_more"),
    )
    return found.select(C.composite_key(F.col("unit_key"), F.col("hour_start")).alias("unit_hour_key"), C.date_key(F.col("hour_start")).alias("date_key"), *found.columns)


def training_dataset(features: DataFrame, split_groups: DataFrame | None = None, config: EngineConfig | None = None) -> DataFrame:
    """Eligible encounters with a split from a hash of the patient, or of the group that patients share."""
    config = config or EngineConfig()
    rows = features.where("is_training_eligible")
    if split_groups is None:
        rows = rows.withColumn("split_key", F.col("patient_key"))
    else:
        groups = split_groups.select(C.stable_key(F.col("patient_id")).alias("_patient"), C.stable_key(F.col("split_group")).alias("_group"))
        rows = rows.join(groups, F.col("patient_key") == F.col("_patient"), "left").withColumn("split_key", F.coalesce("_group", "patient_key"))
    bucket = C.hex_prefix_number(F.col("split_key"), 7) % 10
    return rows.select(
        "encounter_key", "patient_key", "provider_version_key", *FEATURE_COLUMNS, "deterioration_proxy_label", "label_definition_version",
        F.lit(FEATURE_VERSION).alias("feature_schema_version"),
        bucket.alias("split_bucket"),
        F.when(bucket < config.train_buckets, "train").otherwise("test").alias("data_split"),
    )


def scoring_dataset(features: DataFrame) -> DataFrame:
    return features.where("is_scoring_eligible").select(
        "encounter_key", "patient_key", "provider_version_key", *FEATURE_COLUMNS, "label_definition_version", F.lit(FEATURE_VERSION).alias("feature_schema_version")
    )


PREDICTION_COLUMNS = (
    "model_version", "encounter_key", "patient_key", "data_split", "actual_label", "deterioration_probability", "predicted_label", "decision_threshold",
    "feature_schema_version", "label_definition_version", "dataset_fingerprint", "scored_at",
)


def predictions_serving(published: DataFrame) -> DataFrame:
    return published.select(*PREDICTION_COLUMNS)


def predictions_latest(serving: DataFrame, approved_version: str) -> DataFrame:
    """The approved model's predictions with their scope and band."""
    return serving.where(F.col("model_version") == approved_version).select(
        *PREDICTION_COLUMNS,
        F.lit("synthetic_portfolio_only").alias("prediction_scope"),
        F.lit(False).alias("is_clinically_validated"),
        F.when(F.col("predicted_label") == 1, "elevated_proxy").otherwise("baseline_proxy").alias("proxy_risk_band"),
    )


def latest_predictions_report(latest: DataFrame, patients: DataFrame, encounters: DataFrame, features: DataFrame) -> DataFrame:
    """Each patient's latest prediction with encounter and feature columns, the most probable first."""
    shown = ("feature_observation_count", "heart_rate_mean", "respiratory_rate_mean", "spo2_mean", "systolic_bp_mean", "diastolic_bp_mean")
    best = latest.groupBy("patient_key").agg(F.max_by(F.struct(*latest.columns), F.struct("scored_at", "encounter_key")).alias("p")).select("p.*")
    joined = best.join(patients.select("patient_key", F.col("patient_reference").alias("patient_id")), "patient_key").join(encounters.select("encounter_key", "encounter_id"), "encounter_key")
    joined = joined.join(features.select("encounter_key", *shown), "encounter_key", "left")
    names = ["patient_id", "encounter_id", "encounter_key", "model_version", "deterioration_probability", "predicted_label", "decision_threshold", "proxy_risk_band", "scored_at"]
    return joined.select(*names, *shown).orderBy(F.col("deterioration_probability").desc(), "patient_id")
