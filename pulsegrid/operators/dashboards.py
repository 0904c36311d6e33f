"""The reports of the operational dashboards, each a named aggregation over the gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(df: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Rows in a report's period, ends included; an open end where it is none."""
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    return df.where(F.col(time) <= F.lit(end).cast("timestamp")) if end else df


def _series(df: DataFrame, time: Column, metric: Column, value: Column, name: str) -> DataFrame:
    return df.groupBy(time.alias("time"), metric.alias("metric")).agg(value.alias(name))


def census_by_unit(census: DataFrame) -> DataFrame:
    return _series(census, F.col("hour_start"), F.col("unit"), F.sum("census"), "census")


def census_by_care_level(census: DataFrame, units: DataFrame) -> DataFrame:
    return _series(census.join(units.select("unit_key", "care_level"), "unit_key"), F.col("hour_start"), F.col("care_level"), F.sum("census"), "census")


def flow_per_hour(census: DataFrame) -> DataFrame:
    return census.groupBy(F.col("hour_start").alias("time")).agg(F.sum("admissions").alias("admissions"), F.sum("discharges").alias("discharges"))


def acute_patients(census: DataFrame) -> DataFrame:
    return _series(census, F.col("hour_start"), F.col("unit"), F.sum("patients_news2_5_or_more"), "patients")


def census_summary(census: DataFrame) -> DataFrame:
    return census.groupBy("unit").agg(F.max("census").alias("peak_census"), F.avg("census").alias("mean_census"))


def observations_per_hour(facts: DataFrame) -> DataFrame:
    return _series(facts, F.date_trunc("HOUR", "effective_datetime"), F.col("observation_type"), F.count(F.lit(1)), "observations")


def latest_observation(facts: DataFrame) -> DataFrame:
    return facts.agg(F.max("effective_datetime").alias("latest_measured"), F.max("received_at").alias("latest_received"))


def observations_by_vital(facts: DataFrame) -> DataFrame:
    return facts.groupBy("observation_type").agg(F.count(F.lit(1)).alias("observations"))


def news2_completeness(news2: DataFrame) -> DataFrame:
    return news2.agg(F.count("news2_total").alias("complete"), F.count(F.lit(1)).alias("encounters"))


def rejections_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("records"))


def risk_bands_by_unit(admissions: DataFrame, news2: DataFrame) -> DataFrame:
    total = F.col("news2_total")
    band = F.when(total >= 7, "High (7+)").when(total >= 5, "Medium (5-6)").otherwise("Low (0-4)")
    rows = admissions.join(news2.select("encounter_key", "news2_total"), "encounter_key").where("news2_total is not null")
    return rows.groupBy("unit", band.alias("risk_band")).agg(F.count(F.lit(1)).alias("admissions"))


def mean_news2_by_day(admissions: DataFrame, news2: DataFrame) -> DataFrame:
    rows = admissions.join(news2.select("encounter_key", "news2_total"), "encounter_key")
    return _series(rows, F.date_trunc("DAY", "admitted_at"), F.col("unit"), F.avg("news2_total"), "mean_news2")


def deterioration_rate(admissions: DataFrame, training: DataFrame, by: str) -> DataFrame:
    rows = admissions.join(training.select("encounter_key", "deterioration_proxy_label"), "encounter_key")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("admissions"), F.avg("deterioration_proxy_label").alias("deterioration_rate"))


def admissions_by_diagnosis_source(admissions: DataFrame) -> DataFrame:
    return admissions.groupBy("diagnosis_source").agg(F.count(F.lit(1)).alias("admissions"))


def recent_sums(metrics: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Errors and invocations of the trailing minutes, for a health gate."""
    end = F.lit(as_of).cast("timestamp")
    rows = metrics.where((F.col("at") > F.timestamp_add("MINUTE", F.lit(-minutes), end)) & (F.col("at") <= end))
    return rows.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("invocations"), F.lit(0)).alias("invocations"))
