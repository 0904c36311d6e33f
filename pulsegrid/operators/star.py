"""Staging view, dimensions and core facts of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import EngineConfig
from pulsegrid.functions import columns as C
from pulsegrid.session import keep

FAR = "9999-12-31"


def small(df: DataFrame, config: EngineConfig) -> DataFrame:
    """df with a broadcast hint where a bound on its bytes proves it small; else as it is, for a join that AQE plans.

    The bound is rows (counted up to broadcast_rows) times their average size, from one bounded job.
    """
    head = df.limit(config.broadcast_rows + 1)
    row = head.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return F.broadcast(df) if row.n <= config.broadcast_rows and (row.b or 0) <= config.broadcast_bytes else df


def staged_observations(processed: DataFrame, active_patients: list[str] | DataFrame | None = None) -> DataFrame:
    """Processed rows with an encounter, of active patients: a list, or a table (patient_id) for long ones."""
    out = processed.where(~C.is_blank(F.col("encounter_id")))
    if active_patients is None:
        return out
    if isinstance(active_patients, DataFrame):
        return out.join(active_patients.select(F.trim("patient_id").alias("patient_id")), "patient_id", "left_semi").select(*processed.columns)
    return out.where(F.col("patient_id").isin([p.strip() for p in active_patients]))


def dim_date(staged: DataFrame) -> DataFrame:
    days = staged.where("effective_datetime is not null").select(F.to_date("effective_datetime").alias("full_date")).distinct()
    return days.select(C.date_key(F.col("full_date")).alias("date_key"), "full_date", *(c.alias(n) for n, c in C.calendar(F.col("full_date")).items()))


def dim_observation_type(staged: DataFrame) -> DataFrame:
    kinds = staged.where("loinc_code is not null").select("observation_type", "loinc_code", "unit").distinct()
    return kinds.select(C.stable_key(F.col("loinc_code")).alias("observation_type_key"), "observation_type", "loinc_code", "unit", F.lit("http://loinc.org").alias("code_system"))


def dim_patient(staged: DataFrame) -> DataFrame:
    ids = staged.where("patient_id is not null").select("patient_id").distinct()
    return ids.select(
        C.stable_key(F.col("patient_id")).alias("patient_key"),
        "patient_id",
        F.concat(F.lit("Patient/"), "patient_id").alias("patient_reference"),
        F.lit("HAPI FHIR R4").alias("source_system"),
        F.lit("synthetic").alias("data_classification"),
    )


def dim_provider(history: DataFrame) -> DataFrame:
    """Type-2 provider versions from trimmed text columns; a blank valid_to is open."""
    typed = history.select(
        *(F.trim(c).alias(c) for c in ("provider_npi", "provider_name", "taxonomy_code", "taxonomy_description", "provider_state")),
        F.trim(F.col("valid_from").cast("string")).cast("date").alias("valid_from"),
        C.blank_to_null(F.col("valid_to").cast("string")).cast("date").alias("valid_to"),
        F.col("is_current").cast("boolean").alias("is_current"),
        F.trim("data_source").alias("data_source"),
    )
    keys = [C.composite_key(F.col("provider_npi"), F.col("valid_from")).alias("provider_version_key"), C.stable_key(F.col("provider_npi")).alias("provider_key")]
    return typed.select(*keys, *typed.columns)


def dim_facility(facilities: DataFrame) -> DataFrame:
    return facilities.select(C.stable_key(F.col("facility_id")).alias("facility_key"), "facility_id", "facility_name", "city", "state")


def dim_unit(dim_facility: DataFrame, units: DataFrame) -> DataFrame:
    """Every unit of every facility. The unit list is a short seed; facilities are few and unbounded only in principle."""
    return dim_facility.crossJoin(units).select(
        C.composite_key(F.col("facility_id"), F.col("unit_name")).alias("unit_key"), "facility_key", "facility_id", "facility_name", "unit_name", "care_level", "care_level_rank"
    )


def dim_patient_version(payer_history: DataFrame, patients: DataFrame) -> DataFrame:
    """One row for each patient and payer period, with the patient's demographics."""
    periods = payer_history.select("patient_id", "payer_name", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"))
    people = patients.select("patient_id", F.col("birth_date").cast("date").alias("birth_date"), "gender", "race", "ethnicity", "marital_status", "state")
    return periods.join(people, "patient_id").select(
        C.composite_key(F.col("patient_id"), F.col("valid_from")).alias("patient_version_key"),
        C.stable_key(F.col("patient_id")).alias("patient_key"),
        "patient_id", "birth_date", "gender", "race", "ethnicity", "marital_status", "state", "payer_name", "valid_from", "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
    )


def valid_on(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether a half-open version period holds a day; a null end is open."""
    return (day >= valid_from) & (day < F.coalesce(valid_to, F.lit(FAR).cast("date")))


def temporal_join(facts: DataFrame, versions: DataFrame, on: Column, day: Column, how: str = "inner") -> DataFrame:
    """Joins each fact with the version of its key that is valid on its day: an equi join with a range condition."""
    return facts.join(versions, on & valid_on(day, versions["valid_from"], versions["valid_to"]), how)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 by a column, without sorting all rows in one task.

    A range partitioning sorts; each part's count gives the next part's first number. Ties are numbered by all
    columns, so the numbers do not depend on the partitioning. The parts are a checkpoint, because both readers
    must see the same bounds, which Spark samples anew for each plan.
    """
    columns = [order, *(c for c in df.columns if c != order)]
    part = keep(df.repartitionByRange(order, *columns[1:]).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_offset")


def dim_encounter(staged: DataFrame, providers: DataFrame, admissions: DataFrame | None = None, config: EngineConfig | None = None) -> DataFrame:
    """Encounters with the provider version valid on their first day.

    The attending of an admission, else a round-robin choice from the current roster by the encounter's number.
    An encounter whose provider has no version on that day disappears.
    """
    config = config or EngineConfig()
    grouped = (
        staged.where("patient_id is not null")
        .groupBy(F.trim("encounter_id").alias("encounter_id"), "patient_id")
        .agg(F.min("effective_datetime").alias("encounter_start_at"), F.max("effective_datetime").alias("encounter_end_at"))
    )
    # dense numbering over (encounter, patient); a Window without partitions would gather all encounters in one task
    encounters = numbered(grouped.select("encounter_id", "patient_id", "encounter_start_at", "encounter_end_at"), "encounter_id", "encounter_number")
    current = providers.where("is_current").select("provider_npi")
    in_order = Window.orderBy("provider_npi")
    roster = current.select(F.col("provider_npi").alias("roster_npi"), F.row_number().over(in_order).alias("provider_number"), F.count(F.lit(1)).over(Window.partitionBy()).alias("provider_count"))
    size = roster.agg(F.max("provider_count").alias("roster_size"))
    counted = encounters.crossJoin(F.broadcast(size))  # a single row
    assigned = counted.join(small(roster, config), roster["provider_number"] == F.pmod(counted["encounter_number"] - 1, counted["roster_size"]) + 1)
    if admissions is None:
        assigned = assigned.withColumn("attending_npi", F.lit(None).cast("string"))
    else:
        assigned = assigned.join(admissions.select("encounter_id", "attending_npi"), "encounter_id", "left")
    assigned = assigned.select(
        "encounter_id", "patient_id", "encounter_start_at", "encounter_end_at",
        F.coalesce("attending_npi", "roster_npi").alias("assigned_npi"),
        F.col("attending_npi").isNull().alias("is_synthetic_provider_assignment"),
    )
    versions = small(providers.select("provider_npi", "provider_key", "provider_version_key", "valid_from", "valid_to"), config)
    joined = temporal_join(assigned, versions, F.col("assigned_npi") == versions["provider_npi"], F.to_date("encounter_start_at"))
    return joined.select(
        C.stable_key(F.col("encounter_id")).alias("encounter_key"),
        "encounter_id",
        F.concat(F.lit("Encounter/"), "encounter_id").alias("encounter_reference"),
        C.stable_key(F.col("patient_id")).alias("patient_key"),
        "patient_id", "provider_key", "provider_version_key", "encounter_start_at", "encounter_end_at", "is_synthetic_provider_assignment",
    )


def fact_observations(staged: DataFrame, encounters: DataFrame) -> DataFrame:
    """Staged rows of known encounters with all dimension keys."""
    keyed = staged.withColumn("encounter_key", C.stable_key(F.trim("encounter_id")))
    joined = keyed.join(encounters.select("encounter_key", "provider_key", "provider_version_key"), "encounter_key")
    return joined.select(
        C.composite_key(F.col("observation_id"), F.col("loinc_code")).alias("fact_observation_key"),
        C.stable_key(F.col("patient_id")).alias("patient_key"),
        "encounter_key", "provider_key", "provider_version_key",
        C.stable_key(F.col("loinc_code")).alias("observation_type_key"),
        C.date_key(F.col("effective_datetime")).alias("date_key"),
        *staged.columns,
    )


def fact_admissions(admissions: DataFrame, versions: DataFrame, providers: DataFrame) -> DataFrame:
    """Admissions at the patient and attending versions valid on the admission day, where there are any."""
    a = admissions.withColumns({"admitted_at": C.parse_iso(F.col("admitted_at").cast("string")), "discharged_at": C.parse_iso(F.col("discharged_at").cast("string"))})
    v = versions.select(F.col("patient_id").alias("v_patient"), "patient_version_key", "birth_date", F.col("valid_from").alias("v_from"), F.col("valid_to").alias("v_to"))
    p = providers.select("provider_npi", "provider_version_key", "taxonomy_code", "taxonomy_description", F.col("valid_from").alias("p_from"), F.col("valid_to").alias("p_to"))
    day = F.to_date("admitted_at")
    joined = a.join(v, (F.col("patient_id") == F.col("v_patient")) & valid_on(day, F.col("v_from"), F.col("v_to")), "left")
    joined = joined.join(p, (F.col("attending_npi") == F.col("provider_npi")) & valid_on(day, F.col("p_from"), F.col("p_to")), "left")
    return joined.select(
        C.stable_key(F.col("encounter_id")).alias("admission_key"),
        C.stable_key(F.col("encounter_id")).alias("encounter_key"),
        C.stable_key(F.col("patient_id")).alias("patient_key"),
        "patient_version_key",
        C.stable_key(F.col("attending_npi")).alias("provider_key"),
        "provider_version_key",
        C.stable_key(F.col("facility_id")).alias("facility_key"),
        C.composite_key(F.col("facility_id"), F.col("unit")).alias("unit_key"),
        C.date_key(F.col("admitted_at")).alias("admit_date_key"),
        "encounter_id", "run_id", "scenario", "admitted_at", "discharged_at",
        C.whole_div(C.seconds_between(F.col("admitted_at"), F.col("discharged_at")), 3600).alias("length_of_stay_hours"),
        "unit", "diagnosis_code", "diagnosis_display", "diagnosis_source", "attending_npi",
        F.col("taxonomy_code").alias("attending_taxonomy_code"),
        F.col("taxonomy_description").alias("attending_specialty"),
        "birth_date",
        C.age_years(F.col("birth_date"), F.col("admitted_at")).alias("age_at_admission_years"),
    )


def star_join(facts: DataFrame, dims: dict[str, DataFrame], config: EngineConfig | None = None) -> DataFrame:
    """facts with the columns of dimensions, each joined on its key column; small dimensions are broadcast."""
    config = config or EngineConfig()
    for key, dim in dims.items():
        extra = [c for c in dim.columns if c == key or c not in facts.columns]
        facts = facts.join(small(dim.select(*extra), config), key, "left")
    return facts
