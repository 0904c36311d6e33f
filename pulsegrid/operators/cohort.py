"""Cohort reference tables from bundles of health records and from admission encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import BP_PANEL
from pulsegrid.operators.scd import periods

# Code systems and defaults of the record format.
SNOMED = "http://snomed.info/sct"
RACE = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-race"
ETHNICITY = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-ethnicity"
NPI = "http://hl7.org/fhir/sid/us-npi"
FALLBACK_FACILITY = ("synthea-fallback-facility", "Regional General Hospital")
HOSPITAL_CLASSES = ("IMP", "EMER")
SPLIT_CYCLE = 53

_CODING = "array<struct<system: string, code: string, display: string>>"
_REFERENCE = "struct<reference: string, display: string, identifier: struct<system: string, value: string>>"
PATIENT = "id string, birthDate string, gender string, maritalStatus struct<text: string>, address array<struct<city: string, state: string>>, extension array<struct<url: string, extension: array<struct<url: string, valueString: string>>>>"
ENCOUNTER = (
    f"id string, class struct<code: string>, subject {_REFERENCE}, period struct<start: string, `end`: string>, reasonCode array<struct<coding: {_CODING}, text: string>>, "
    f"serviceProvider {_REFERENCE}, location array<struct<location: {_REFERENCE}>>, identifier array<struct<system: string, value: string>>, meta struct<tag: {_CODING}>, "
    f"participant array<struct<type: array<struct<coding: {_CODING}>>, individual: {_REFERENCE}>>"
)
CONDITION = f"code struct<coding: {_CODING}>, encounter {_REFERENCE}"
CLAIM = "billablePeriod struct<start: string>, insurer struct<display: string>"
OBSERVATION = f"id string, code struct<coding: {_CODING}>, component array<struct<code: struct<coding: {_CODING}>, valueQuantity: struct<value: double>>>"


def _extension(url: str) -> Column:
    outer = F.filter("extension", lambda e: e["url"] == url)
    return F.try_element_at(F.filter(F.try_element_at(outer, F.lit(1))["extension"], lambda e: e["url"] == "text"), F.lit(1))["valueString"]


def patients(resources: DataFrame, id_col: str = "patient_id") -> DataFrame:
    return resources.select(
        id_col,
        F.col("birthDate").alias("birth_date"),
        "gender",
        _extension(RACE).alias("race"),
        _extension(ETHNICITY).alias("ethnicity"),
        F.col("maritalStatus.text").alias("marital_status"),
        F.try_element_at("address", F.lit(1))["state"].alias("state"),
    )


def payer_history(claims: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Payer periods from claims (patient_id, billablePeriod, insurer)."""
    flat = claims.select("patient_id", F.col("insurer.display").alias("payer_name"), F.coalesce(F.substring("billablePeriod.start", 1, 10), F.lit("")).alias("start"))
    return periods(flat, "patient_id", "payer_name", "start", keys=cohort)


def blood_pressures(resources: DataFrame) -> DataFrame:
    """(patient_id, observation id, systolic, diastolic) of panels that hold both."""
    rows = resources.where(F.exists("code.coding", lambda c: c["code"] == BP_PANEL))

    def part(loinc: str) -> Column:
        hit = F.filter("component", lambda p: F.exists(p["code"]["coding"], lambda c: c["code"] == loinc) & p["valueQuantity"]["value"].isNotNull())
        return F.try_element_at(hit, F.lit(1))["valueQuantity"]["value"]

    out = rows.select("patient_id", F.col("id").alias("source_observation_id"), part("8480-6").alias("systolic"), part("8462-4").alias("diastolic"))
    return out.where("systolic is not null and diastolic is not null")


def admission_rows(encounters: DataFrame, identifier_system: str, scenario_system: str) -> DataFrame:
    """Admissions from encounters; one that lacks end, reason, provider, unit or attending is dropped."""
    reason = F.try_element_at("reasonCode", F.lit(1))
    coding = F.try_element_at(reason["coding"], F.lit(1))
    unit = F.try_element_at("location", F.lit(1))["location"]["display"]
    is_attending = lambda p: F.exists(p["type"], lambda t: F.exists(t["coding"], lambda c: c["code"] == "ATND")) & (p["individual"]["identifier"]["system"] == NPI)
    npi = F.try_element_at(F.filter("participant", is_attending), F.lit(1))["individual"]["identifier"]["value"]
    own = F.try_element_at(F.filter("identifier", lambda i: i["system"] == identifier_system), F.lit(1))["value"]
    out = encounters.select(
        F.col("id").alias("encounter_id"),
        F.regexp_replace("subject.reference", "^Patient/", "").alias("patient_id"),
        F.substring_index(own, ":", 1).alias("run_id"),
        F.try_element_at(F.filter("meta.tag", lambda t: t["system"] == scenario_system), F.lit(1))["code"].alias("scenario"),
        F.col("period.start").alias("admitted_at"),
        F.col("period.end").alias("discharged_at"),
        F.col("serviceProvider.identifier.value").alias("facility_id"),
        F.col("serviceProvider.display").alias("facility_name"),
        unit.alias("unit"),
        coding["code"].alias("diagnosis_code"),
        coding["display"].alias("diagnosis_display"),
        reason["text"].alias("diagnosis_source"),
        npi.alias("attending_npi"),
    )
    needed = ("discharged_at", "diagnosis_code", "facility_name", "unit", "attending_npi")
    return out.where(" and ".join(f"coalesce({c}, '') <> ''" for c in needed))


def admission_profile(encounters: DataFrame, conditions: DataFrame) -> DataFrame:
    """Each patient's facilities (hospital ones where there are any) and disorders, in order of first sight.

    encounters and conditions: resources with patient_id and position in their bundle.
    """
    organization = F.substring_index(F.coalesce("serviceProvider.reference", F.lit("")), "|", -1)
    visits = encounters.select("patient_id", "position", F.concat(F.lit("urn:uuid:"), "id").alias("visit"), organization.alias("facility_id"), F.col("serviceProvider.display").alias("facility_name"), F.coalesce(F.col("class.code").isin(*HOSPITAL_CLASSES), F.lit(False)).alias("hospital"))
    named = visits.where("facility_id <> '' and coalesce(facility_name, '') <> ''")
    seen = named.groupBy("patient_id", "facility_id").agg(F.min("position").alias("first"), F.min(F.when(F.col("hospital"), F.col("position"))).alias("hospital_first"), F.min_by("facility_name", "position").alias("name"))
    lists = seen.groupBy("patient_id").agg(
        F.array_sort(F.collect_list(F.struct("first", F.col("facility_id").alias("id"), "name"))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("hospital_first").isNotNull(), F.struct(F.col("hospital_first").alias("first"), F.col("facility_id").alias("id"), "name")))).alias("hospitals"),
    )
    strip = lambda a: F.transform(a, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    facilities = lists.select("patient_id", strip(F.when(F.size("hospitals") > 0, F.col("hospitals")).otherwise(F.col("all"))).alias("facilities"))
    disorder = lambda c: (c["system"] == SNOMED) & c["display"].endswith("(disorder)")
    codes = conditions.select("patient_id", "position", F.col("encounter.reference").alias("visit"), F.explode(F.filter("code.coding", disorder)).alias("c"))
    marked = codes.join(visits.where("hospital").select("patient_id", "visit", F.lit(True).alias("at_hospital")).distinct(), ["patient_id", "visit"], "left")
    first = marked.groupBy("patient_id", F.col("c.code").alias("code")).agg(F.min("position").alias("first"), F.min(F.when(F.col("at_hospital"), F.col("position"))).alias("hospital_first"), F.min_by("c.display", "position").alias("display"))
    pair = lambda a: F.transform(a, lambda x: F.struct(x["code"].alias("code"), x["display"].alias("display")))
    diagnoses = first.groupBy("patient_id").agg(
        pair(F.array_sort(F.collect_list(F.struct("first", "code", "display")))).alias("diagnoses"),
        pair(F.array_sort(F.collect_list(F.when(F.col("hospital_first").isNotNull(), F.struct(F.col("hospital_first").alias("first"), "code", "display"))))).alias("hospital_diagnoses"),
    )
    return facilities.join(diagnoses, "patient_id", "full_outer")


def facilities(organizations: DataFrame, referenced: DataFrame) -> DataFrame:
    """Organizations whose id is referenced, and the fallback facility where that is."""
    kept = organizations.join(referenced.select("facility_id").distinct(), "facility_id", "left_semi").select("facility_id", "facility_name", "city", "state")
    none = F.lit(None).cast("string")
    fallback = referenced.where(F.col("facility_id") == FALLBACK_FACILITY[0]).select("facility_id").distinct()
    return kept.unionByName(fallback.select("facility_id", F.lit(FALLBACK_FACILITY[1]).alias("facility_name"), none.alias("city"), none.alias("state")))


def split_groups(cohort: DataFrame, position: str = "position") -> DataFrame:
    """Each patient's waveform split group by its place in the cohort, from 1: records repeat after a cycle."""
    record = F.pmod(F.col(position) - 1, F.lit(SPLIT_CYCLE)) + 1
    return cohort.select("patient_id", F.concat(F.lit("bidmc"), F.lpad(record.cast("string"), 2, "0")).alias("split_group"), C.whole_div(F.col(position).cast("long") - 1, SPLIT_CYCLE).alias("epoch"))


def recent_encounters(encounters: DataFrame) -> DataFrame:
    """Each patient's most recent encounter."""
    return encounters.groupBy("patient_id").agg(F.max_by(F.struct(*encounters.columns), F.struct("period.start", "id")).alias("r")).select("r.*")


def sanitised(resources: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    """Resources without fields that refer to others."""
    return resources.drop(*drop)


def cohort(bundles: DataFrame, size: int, path: str = "path") -> DataFrame:
    """The first bundles by path; an error where there are fewer."""
    chosen = bundles.orderBy(path).limit(size)
    found = chosen.count()
    if found < size:
        raise ValueError(f"the cohort needs {size} bundles but only {found} were found")
    return chosen
