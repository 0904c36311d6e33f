"""The deterioration model: contract checks, training, published parameters and predictions."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import MODEL_FEATURES
from pulsegrid.operators import stats
from pulsegrid.operators.quality import table_fingerprint
from pulsegrid.session import keep

TARGET = "deterioration_proxy_label"
REQUIRED = ("encounter_key", "patient_key", "data_split", "feature_schema_version", "label_definition_version", TARGET, *MODEL_FEATURES)
SCORING_REQUIRED = ("encounter_key", "patient_key", "feature_schema_version", "label_definition_version", *MODEL_FEATURES)


class ContractError(ValueError):
    """A dataset or published model does not meet its contract."""


def validate_training(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ContractError(f"training dataset is missing columns: {', '.join(missing)}")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.collect_set("data_split").alias("splits"), F.count_distinct("feature_schema_version").alias("f"), F.count_distinct("label_definition_version").alias("l")).first()
    if not r.n:
        raise ContractError("training dataset is empty")
    if set(r.splits) != {"train", "test"}:
        raise ContractError("training dataset must contain only train and test partitions")
    if r.f != 1 or r.l != 1:
        raise ContractError("training dataset must contain one feature schema version and one label definition version")


def validate_scoring(df: DataFrame, manifest: dict) -> None:
    missing = [c for c in SCORING_REQUIRED if c not in df.columns]
    if missing:
        raise ContractError(f"scoring dataset is missing columns: {', '.join(missing)}")
    versions = sorted(r[0] for r in df.select("feature_schema_version").distinct().limit(100).collect())
    if not versions:
        raise ContractError("scoring dataset is empty")
    if versions != manifest.get("feature_schema_versions"):
        raise ContractError("scoring dataset feature schema does not match the approved model")


def dataset_fingerprint(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row: SHA-256 of the rows' texts in key order as a JSON array, for datasets of one row per encounter.

    The ordered text is built in one task, as the definition demands; quality.table_fingerprint scales further.
    """
    texts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in df.columns else F.lit("") for c in columns))
    rows = df.select(F.struct(F.col("encounter_key").cast("string").alias("k"), texts.alias("t")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])
    return rows.agg(F.sha2(F.to_json(ordered), 256).alias("fingerprint"))


def train(df: DataFrame) -> dict:
    """Median imputation, standard scaling and a balanced, L2-penalised logistic fit on the train split.

    The penalty holds the intercept too, as a constant column; returns parameters and manifest as plain data. The
    dataset's fingerprint is the one that needs no order (``table_fingerprint``), so no task sees all rows.
    """
    df = keep(df)  # read by each of the steps below
    validate_training(df)
    rows = df.where("data_split = 'train'")
    counts = {r[TARGET]: r["n"] for r in rows.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ContractError("training partition must contain labels 0 and 1")
    values = {c: C.finite(F.col(c).cast("double")) for c in MODEL_FEATURES}
    medians = rows.agg(*(F.coalesce(F.median(v), F.lit(0.0)).alias(c) for c, v in values.items())).first()
    filled = {c: F.coalesce(v, F.lit(medians[c])) for c, v in values.items()}
    moments = rows.agg(*(F.avg(v).alias(f"{c}_m") for c, v in filled.items()), *(F.stddev_pop(v).alias(f"{c}_s") for c, v in filled.items())).first()
    means = [moments[f"{c}_m"] for c in MODEL_FEATURES]
    scales = [moments[f"{c}_s"] or 1.0 for c in MODEL_FEATURES]
    z = [(filled[c] - F.lit(m)) / F.lit(s) for c, m, s in zip(MODEL_FEATURES, means, scales, strict=True)]
    n = sum(counts.values())
    weight = F.when(F.col(TARGET) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    beta = stats.logistic_fit(rows, [*z, F.lit(1.0)], F.col(TARGET), weight, ridge=1.0)
    fingerprint = table_fingerprint(df.select(*REQUIRED)).first().fingerprint
    versions = df.agg(F.sort_array(F.collect_set("feature_schema_version")).alias("f"), F.sort_array(F.collect_set("label_definition_version")).alias("l"), F.count_if(F.col("data_split") == "test").alias("t")).first()
    manifest = {
        "model_type": "logistic_regression",
        "model_version": f"logistic-{fingerprint[:12]}",
        "dataset_fingerprint": fingerprint,
        "feature_columns": list(MODEL_FEATURES),
        "target_column": TARGET,
        "feature_schema_versions": list(versions.f),
        "label_definition_versions": list(versions.l),
        "training_row_count": n,
        "test_row_count": versions.t,
        "training_class_counts": {str(k): v for k, v in sorted(counts.items())},
    }
    parameters = {
        "model_version": manifest["model_version"],
        "feature_columns": list(MODEL_FEATURES),
        "medians": [float(medians[c]) for c in MODEL_FEATURES],
        "means": [float(m) for m in means],
        "scales": [float(s) for s in scales],
        "coefficients": [float(b) for b in beta[:-1]],
        "intercept": float(beta[-1]),
    }
    return {"parameters": parameters, "manifest": manifest}


def probability(parameters: dict):
    """The probability column of published parameters."""
    if tuple(parameters["feature_columns"]) != MODEL_FEATURES:
        raise ContractError("the parameters' feature order is not this engine's")
    p = parameters
    return C.logistic([F.col(c) for c in MODEL_FEATURES], p["medians"], p["means"], p["scales"], p["coefficients"], p["intercept"])


def evaluate(df: DataFrame, parameters: dict) -> dict:
    """AUC and operating points on the test split; the selected threshold comes from the train split."""
    scored = df.withColumn("_p", probability(parameters))
    train_rows, test = scored.where("data_split = 'train'"), scored.where("data_split = 'test'")
    chosen = stats.youden(train_rows, TARGET, "_p").first()
    return {
        "roc_auc": stats.auc(test, TARGET, "_p"),
        "default_operating_point": stats.operating_point(test, TARGET, "_p", 0.5).first().asDict(),
        "selected_operating_point": stats.operating_point(test, TARGET, "_p", chosen.threshold).first().asDict(),
        "threshold": chosen.threshold,
    }


def predict(df: DataFrame, parameters: dict, threshold: float, scored_at: str, fingerprint: str | None = None) -> DataFrame:
    """Prediction rows of the serving schema."""
    have = set(df.columns)
    return df.withColumn("_p", probability(parameters)).select(
        F.lit(parameters["model_version"]).alias("model_version"), "encounter_key", "patient_key",
        (F.col("data_split") if "data_split" in have else F.lit(None).cast("string")).alias("data_split"),
        (F.col(TARGET).cast("int") if TARGET in have else F.lit(None).cast("int")).alias("actual_label"),
        F.col("_p").alias("deterioration_probability"),
        (F.col("_p") >= threshold).cast("int").alias("predicted_label"),
        F.lit(float(threshold)).alias("decision_threshold"),
        "feature_schema_version", "label_definition_version",
        F.lit(fingerprint).cast("string").alias("dataset_fingerprint"),
        F.lit(scored_at).alias("scored_at"),
    )


def pack(model: dict, threshold: float) -> dict[str, bytes]:
    """A published model as named blobs: parameters, manifest with its threshold, and the checksums of both."""
    parameters = json.dumps(model["parameters"], sort_keys=True).encode()
    manifest = json.dumps({**model["manifest"], "decision_threshold": threshold, "model_sha256": hashlib.sha256(parameters).hexdigest()}, sort_keys=True).encode()
    sums = json.dumps({"manifest.json": hashlib.sha256(manifest).hexdigest(), "parameters.json": hashlib.sha256(parameters).hexdigest()}, sort_keys=True).encode()
    return {"parameters.json": parameters, "manifest.json": manifest, "checksums.json": sums}


def load(blobs: dict[str, bytes], approved_version: str) -> tuple[dict, dict]:
    """(parameters, manifest) of a published model that passes every guard."""
    sums = json.loads(blobs["checksums.json"])
    for name in ("manifest.json", "parameters.json"):
        if hashlib.sha256(blobs[name]).hexdigest() != sums.get(name):
            raise ContractError(f"{name} does not match its checksum")
    parameters, manifest = json.loads(blobs["parameters.json"]), json.loads(blobs["manifest.json"])
    if manifest.get("model_version") != approved_version or parameters.get("model_version") != approved_version:
        raise ContractError("the published model is not the approved version")
    if list(manifest.get("feature_columns", ())) != list(MODEL_FEATURES):
        raise ContractError("the published model's feature order is not this engine's")
    if manifest.get("decision_threshold") is None:
        raise ContractError("the published model has no decision threshold")
    if manifest.get("model_sha256") != hashlib.sha256(blobs["parameters.json"]).hexdigest():
        raise ContractError("the manifest names another model")
    return parameters, manifest


def boosted_trees(df: DataFrame, features: list[str], label: str, iterations: int = 200, seed: int = 0):
    """A gradient-boosted tree model from Spark's library; an approximation of histogram boosting with 15 leaves."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_{f}" for f in features]
    imputer = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(df)
    rows = VectorAssembler(inputCols=filled, outputCol="_x").transform(imputer.transform(df))
    return GBTClassifier(featuresCol="_x", labelCol=label, maxIter=iterations, stepSize=0.05, maxDepth=4, seed=seed).fit(rows)


def scoring_frame(spark: SparkSession, parameters: dict) -> DataFrame:
    """Parameters as a table, one row for each feature."""
    p = parameters
    rows = list(zip(p["feature_columns"], p["medians"], p["means"], p["scales"], p["coefficients"], strict=True))
    return spark.createDataFrame(rows, "feature string, median double, mean double, scale double, coefficient double")


def coefficients(parameters: dict) -> np.ndarray:
    return np.array([*parameters["coefficients"], parameters["intercept"]])
