"""Queries over the model, its evaluation and the study's statistics, with closed forms in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.catalog import FEATURE_COLUMNS, FEATURES, MODEL_FEATURES
from pulsegrid.operators import features as feats
from pulsegrid.operators import model, quality, star, stats, study
from pulsegrid.plans.domain import Domain, sql
from pulsegrid.plans.registry import register
from pulsegrid.plans.vitals import _EVENTS, _events, show
from pulsegrid.session import keep
from pulsegrid.streaming import state

# ---- model ----


def _labelled(d: Domain) -> DataFrame:
    """Features with a split and a label from the encounter's key, so that both classes are in both splits."""
    part = lambda at: C.hex_prefix_number(F.substring("encounter_key", at, 7), 7)
    rows = d.features.withColumns({"data_split": F.when(part(1) % 4 == 0, "test").otherwise("train"), "feature_schema_version": F.lit("f"), "deterioration_proxy_label": (part(9) % 2).cast("int")})
    return rows.select("encounter_key", "patient_key", "data_split", "feature_schema_version", "label_definition_version", "deterioration_proxy_label", *MODEL_FEATURES)


_LABELLED = "(SELECT *, CASE WHEN CAST('0x' || substr(encounter_key, 1, 7) AS BIGINT) % 4 = 0 THEN 'test' ELSE 'train' END AS split, CAST('0x' || substr(encounter_key, 9, 7) AS BIGINT) % 2 AS y FROM features)"


def _scaling_sql(f: str) -> str:
    return f"SELECT '{f}' AS feature, m AS median, avg(coalesce({f}, m)) AS mean, stddev_pop(coalesce({f}, m)) AS scale FROM {_LABELLED}, (SELECT coalesce(median({f}), 0) AS m FROM {_LABELLED} WHERE split = 'train') WHERE split = 'train' GROUP BY m"


@register("ml1_trained_parameters", sql("SELECT feature, round(median, 6) AS median, round(mean, 6) AS mean, round(CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) AS scale, CAST(0 AS DOUBLE) AS gradient FROM (" + " UNION ALL ".join(_scaling_sql(f) for f in MODEL_FEATURES) + ") UNION ALL SELECT 'intercept', NULL, NULL, NULL, 0", "features"))
def trained_parameters(spark, sf):
    """Imputation and scaling, and the penalised loss's gradient at the coefficients, which the fit makes zero."""
    rows = keep(_labelled(Domain(spark, sf)))
    fitted = model.train(rows)["parameters"]
    train = rows.where("data_split = 'train'")
    n = {r.y: r.n for r in train.groupBy(F.col("deterioration_proxy_label").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    y = F.col("deterioration_proxy_label")
    weight = F.when(y == 1, sum(n.values()) / (2.0 * n[1])).otherwise(sum(n.values()) / (2.0 * n[0]))
    z = {f: (F.coalesce(F.col(f), F.lit(m)) - F.lit(a)) / F.lit(s) for f, m, a, s in zip(MODEL_FEATURES, fitted["medians"], fitted["means"], fitted["scales"], strict=True)} | {"intercept": F.lit(1.0)}
    off = weight * (model.probability(fitted) - y)
    beta = dict(zip([*MODEL_FEATURES, "intercept"], model.coefficients(fitted).tolist(), strict=True))
    gradient = train.agg(*((F.sum(off * x) + F.lit(beta[f])).alias(f) for f, x in z.items())).first()
    shown = {r.feature: r for r in model.scoring_frame(spark, fitted).collect()}
    out = [(f, *((round(shown[f].median, 6), round(shown[f].mean, 6), round(shown[f].scale, 6)) if f in shown else (None, None, None)), abs(round(gradient[f], 6))) for f in z]
    return spark.createDataFrame(out, "feature string, median double, mean double, scale double, gradient double")


def _outcome(call) -> str:
    try:
        call()
    except ValueError as error:
        return str(error)
    return "accepted"


@register("ml2_dataset_contract", "SELECT * FROM (VALUES ('whole', 'accepted'), ('without a column', 'training dataset is missing columns: patient_key'), ('empty', 'training dataset is empty'), ('one split', 'training dataset must contain only train and test partitions'), ('two versions', 'training dataset must contain one feature schema version and one label definition version')) AS t(dataset, outcome)")
def dataset_contract(spark, sf):
    rows = keep(_labelled(Domain(spark, sf)))
    first = F.col("encounter_key") < "8"
    cases = {"whole": rows, "without a column": rows.drop("patient_key"), "empty": rows.where("false"), "one split": rows.where("data_split = 'train'"), "two versions": rows.withColumn("feature_schema_version", F.when(first, "f").otherwise("g"))}
    return spark.createDataFrame([(name, _outcome(lambda df=df: model.validate_training(df))) for name, df in cases.items()], "dataset string, outcome string")


@register("ml3_manifest", sql(f"SELECT 'logistic_regression' AS model_type, count(*) FILTER (split = 'train') AS training_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'train' AND y = 0) AS negatives, count(*) FILTER (split = 'train' AND y = 1) AS positives, true AS version_follows, true AS order_free FROM {_LABELLED}", "features"))
def manifest(spark, sf):
    rows = keep(_labelled(Domain(spark, sf)))
    m = model.train(rows)["manifest"]
    again = quality.table_fingerprint(rows.select(*model.REQUIRED).orderBy(F.desc("encounter_key"))).first().fingerprint
    held = (m["model_type"], m["training_row_count"], m["test_row_count"], m["training_class_counts"]["0"], m["training_class_counts"]["1"], m["model_version"] == f"logistic-{m['dataset_fingerprint'][:12]}", m["dataset_fingerprint"] == again)
    return spark.createDataFrame([held], "model_type string, training_rows long, test_rows long, negatives long, positives long, version_follows boolean, order_free boolean")


_PARAMETERS = {"model_version": "m7", "feature_columns": list(MODEL_FEATURES), "medians": [80.0] * 12, "means": [75.0] * 12, "scales": [10.0] * 12, "coefficients": [0.5, -0.25, *[0.0] * 9, 0.125], "intercept": 0.1}


@register("ml7_prediction_rows", sql(f"SELECT 'm7' AS model_version, encounter_key, data_split, round(p, 9) AS deterioration_probability, CASE WHEN p >= 0.55 THEN 1 ELSE 0 END AS predicted_label, deterioration_proxy_label AS actual_label, 0.55 AS decision_threshold FROM (SELECT *, 1 / (1 + exp(-(0.1 + 0.5 * (coalesce({MODEL_FEATURES[0]}, 80) - 75) / 10 - 0.25 * (coalesce({MODEL_FEATURES[1]}, 80) - 75) / 10 + 0.125 * (coalesce({MODEL_FEATURES[11]}, 80) - 75) / 10))) AS p FROM training)", "training"))
def prediction_rows(spark, sf):
    rows = Domain(spark, sf).training
    out = model.predict(rows, _PARAMETERS, 0.55, "2024-01-01")
    return out.select("model_version", "encounter_key", "data_split", F.round("deterioration_probability", 9).alias("deterioration_probability"), "predicted_label", "actual_label", "decision_threshold")


@register("ml8_load_guards", "SELECT * FROM (VALUES ('whole', 'accepted'), ('other version', 'the published model is not the approved version'), ('changed parameters', 'parameters.json does not match its checksum'), ('changed manifest', 'manifest.json does not match its checksum'), ('other features', 'the published model''s feature order is not this engine''s'), ('no threshold', 'the published model has no decision threshold'), ('another model', 'the manifest names another model')) AS t(published, outcome)")
def load_guards(spark, sf):
    import hashlib
    import json

    Domain(spark, sf)
    blobs = model.pack({"parameters": _PARAMETERS, "manifest": {"model_version": "m7", "feature_columns": list(MODEL_FEATURES)}}, 0.5)

    def changed(**fields) -> dict[str, bytes]:
        """The blobs with another manifest, whose checksum is renewed."""
        text = json.dumps({**json.loads(blobs["manifest.json"]), **fields}, sort_keys=True).encode()
        sums = {**json.loads(blobs["checksums.json"]), "manifest.json": hashlib.sha256(text).hexdigest()}
        return {**blobs, "manifest.json": text, "checksums.json": json.dumps(sums).encode()}

    cases = {
        "whole": (blobs, "m7"), "other version": (blobs, "m8"), "changed parameters": ({**blobs, "parameters.json": blobs["parameters.json"] + b" "}, "m7"), "changed manifest": ({**blobs, "manifest.json": blobs["manifest.json"] + b" "}, "m7"),
        "other features": (changed(feature_columns=["x"]), "m7"), "no threshold": (changed(decision_threshold=None), "m7"), "another model": (changed(model_sha256="0"), "m7"),
    }
    return spark.createDataFrame([(name, _outcome(lambda b=b, v=v: model.load(b, v))) for name, (b, v) in cases.items()], "published string, outcome string")


@register("agg18_dataset_fingerprint", sql("SELECT sha256(CAST(to_json(list([encounter_key, patient_key, data_split] ORDER BY encounter_key)) AS VARCHAR)) AS fingerprint FROM training", "training"))
def dataset_fingerprint(spark, sf):
    columns = ("encounter_key", "patient_key", "data_split")
    return model.dataset_fingerprint(Domain(spark, sf).training.select(*columns), columns)


_SHOWN = ("heart_rate_mean", "respiratory_rate_mean", "spo2_mean", "systolic_bp_mean", "diastolic_bp_mean")


@register("join13_latest_predictions_report", sql("SELECT 'Patient/' || e.patient_id AS patient_id, e.encounter_id, f.encounter_key, round(f.feature_observation_count / 100.0, 6) AS deterioration_probability, 'elevated_proxy' AS proxy_risk_band, f.feature_observation_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SHOWN) + " FROM features f JOIN encounters e ON e.encounter_key = f.encounter_key QUALIFY row_number() OVER (PARTITION BY f.patient_key ORDER BY f.encounter_key DESC) = 1", "features", "encounters"))
def predictions_report(spark, sf):
    d = Domain(spark, sf)
    rows = d.features.select("encounter_key", "patient_key", (F.col("feature_observation_count") / 100.0).alias("deterioration_probability"))
    fixed = {"model_version": "m1", "data_split": "test", "actual_label": 0, "predicted_label": 1, "decision_threshold": 0.5, "feature_schema_version": "f", "label_definition_version": "l", "dataset_fingerprint": "x", "scored_at": "2024-01-01"}
    latest = feats.predictions_latest(rows.withColumns({n: F.lit(v) for n, v in fixed.items()}), "m1")
    out = feats.latest_predictions_report(latest, star.dim_patient(d.staged), d.encounters, d.features)
    return show(out, ["patient_id", "encounter_id", "encounter_key", "deterioration_probability", "proxy_risk_band", "feature_observation_count", *_SHOWN])


_SQL_STAT = {"mean": "avg", "min": "min", "max": "max", "stddev": "stddev_samp"}


@register("agg24_window_features", sql("SELECT encounter_id, " + ", ".join(f"round({_SQL_STAT[s]}({v}), 6) AS {n}" for n, v, s in FEATURES) + f" FROM (SELECT *, min(t) OVER (PARTITION BY encounter_id) + INTERVAL 10080 MINUTE AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id, t, observation_id ORDER BY arrival DESC) AS r FROM ({_EVENTS}) WHERE encounter_id IS NOT NULL AND coalesce(source, '') <> 'load_test' AND observation_id IS NOT NULL) WHERE r = 1) WHERE t < cutoff GROUP BY 1", "wide"))
def window_features(spark, sf):
    readings = state.window_readings(_events(Domain(spark, sf)).where("observation_id is not null"))
    out = state.window_scores(readings, F.lit("2024-01-09 00:00:00").cast("timestamp"), 10080, None, "m1", FEATURES)
    return show(out, ["encounter_id", *FEATURE_COLUMNS])


# ---- the study's frames ----

_ADMITTED = "(SELECT md5('enc' || c_custkey) AS encounter_key, c_custkey % 90 AS age, (['22298006', '233604007', '91302008', '000'])[c_custkey % 4 + 1] AS diagnosis_code, (['207RC0200X', '207RC0000X', '208M00000X', '208600000X'])[c_custkey % 4 + 1] AS taxonomy FROM customer)"
_GROUPS = "(SELECT md5('p' || c_custkey) AS patient_key, 'g' || (c_custkey % 7) AS split_group FROM customer)"


def _frame(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % 4 + 1).cast("int"))
    admissions = d.table("customer").select(F.md5(F.concat(F.lit("enc"), k)).alias("encounter_key"), (k % 90).alias("age_at_admission_years"), pick("22298006", "233604007", "91302008", "000").alias("diagnosis_code"), pick("207RC0200X", "207RC0000X", "208M00000X", "208600000X").alias("attending_taxonomy_code"))
    groups = d.table("customer").select(F.concat(F.lit("p"), k).alias("patient_id"), F.concat(F.lit("g"), k % 7).alias("split_group"))
    return study.encounter_frame(d.training, d.news2, feats.trend_features(d.minutes), admissions, groups)


_FRAME = f"SELECT t.encounter_key, t.deterioration_proxy_label AS label, n.news2_total, s.slope, a.age, a.diagnosis_code, a.taxonomy, g.split_group FROM training t JOIN news2 n ON n.encounter_key = t.encounter_key JOIN (SELECT encounter_key, regr_slope(heart_rate_mean, CAST(minute_index AS DOUBLE)) AS slope FROM minutes GROUP BY 1) s ON s.encounter_key = t.encounter_key JOIN {_ADMITTED} a ON a.encounter_key = t.encounter_key JOIN {_GROUPS} g ON g.patient_key = t.patient_key"


@register("join15_encounter_frame", sql(f"SELECT encounter_key, label, news2_total, round(slope, 8) AS heart_rate_slope, age AS age_at_admission_years, split_group FROM ({_FRAME})", "training", "news2", "minutes"))
def encounter_frame(spark, sf):
    return show(_frame(Domain(spark, sf)), ["encounter_key", "label", "news2_total", "heart_rate_slope", "age_at_admission_years", "split_group"], 8)


@register("join18_minute_frame", sql(f"SELECT m.encounter_key, minute_index, round(heart_rate_mean, 6) AS heart_rate, round(last_value(systolic_bp_mean IGNORE NULLS) OVER (PARTITION BY m.encounter_key ORDER BY minute_index ROWS UNBOUNDED PRECEDING), 6) AS systolic_bp, CASE WHEN age >= 65 THEN 1 ELSE 0 END AS age_65_plus, CASE diagnosis_code WHEN '22298006' THEN 'Cardiovascular' WHEN '233604007' THEN 'Respiratory' WHEN '91302008' THEN 'Infection and shock' ELSE 'Other' END AS diagnosis_group FROM minutes m JOIN ({_FRAME}) f ON f.encounter_key = m.encounter_key WHERE news2_total IS NOT NULL", "training", "news2", "minutes"))
def minute_frame(spark, sf):
    d = Domain(spark, sf)
    out = study.minute_frame(d.minutes, study.analysis_set(_frame(d), ["22298006", "233604007", "91302008", "000"]))
    return show(out, ["encounter_key", "minute_index", "heart_rate", "systolic_bp", "age_65_plus", "diagnosis_group"])


@register("agg25_window_rise", "SELECT user_id, round(avg(value) FILTER (s >= 432000 AND s < 864000) - avg(value) FILTER (s >= 0 AND s < 432000), 6) AS rise FROM (SELECT user_id, value, date_diff('second', min(t) OVER (PARTITION BY user_id), t) AS s FROM (SELECT user_id, value, date_trunc('second', ts) AS t FROM events)) GROUP BY 1")
def window_rise(spark, sf):
    e = Domain(spark, sf).table("events").select("user_id", "value", F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("t"))
    return show(stats.window_rise(e, "user_id", "t", "value", (0, 432000), (432000, 864000)), ["user_id", "rise"])


@register("st9_scoring_minute_rise", "SELECT CAST(user_id AS VARCHAR) AS encounter_key, round(max(value) FILTER (event_id % 30 = 14) - avg(value) FILTER (event_id % 30 < 5), 6) AS rise FROM events GROUP BY user_id HAVING max(value) FILTER (event_id % 30 = 14) IS NOT NULL AND avg(value) FILTER (event_id % 30 < 5) IS NOT NULL")
def scoring_minute_rise(spark, sf):
    minutes = Domain(spark, sf).table("events").select(F.col("user_id").cast("string").alias("encounter_key"), (F.col("event_id") % 30).alias("minute_index"), F.col("value").alias("heart_rate"))
    return show(stats.heart_rate_rise(minutes, []), ["encounter_key", "rise"])


# ---- statistics ----


@register("st1_group_folds", sql("SELECT patient_key, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INTEGER) AS fold FROM (SELECT patient_key, row_number() OVER (ORDER BY p DESC, n DESC, md5('0:' || patient_key), patient_key) - 1 AS k FROM (SELECT patient_key, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM predictions GROUP BY 1))", "predictions"))
def group_folds(spark, sf):
    return stats.stratified_group_folds(Domain(spark, sf).predictions, "patient_key", "quality")


_DESIGN = ("heart_rate", "spo2", "temperature")


@register("st2_minute_scaling", sql(" UNION ALL ".join(f"SELECT '{v}' AS vital, round(m, 6) AS median, round(avg(coalesce({v}_mean, m)), 6) AS mean, round(stddev_pop(coalesce({v}_mean, m)), 6) AS deviation FROM minutes, (SELECT median({v}_mean) AS m FROM minutes) GROUP BY m" for v in _DESIGN), "minutes"))
def minute_scaling(spark, sf):
    minutes = Domain(spark, sf).minutes.select("minute_index", *(F.col(f"{v}_mean").alias(v) for v in _DESIGN))
    _, scaling = stats.minute_design(minutes, list(_DESIGN))
    return spark.createDataFrame([(v, *(round(x, 6) for x in s)) for v, s in scaling.items()], "vital string, median double, mean double, deviation double")


@register("st2_design_columns", sql("SELECT encounter_key, minute_index, round(z, 6) AS z, round(z * minute_index, 5) AS by_minute FROM (SELECT encounter_key, minute_index, (coalesce(heart_rate_mean, m) - avg(coalesce(heart_rate_mean, m)) OVER ()) / stddev_pop(coalesce(heart_rate_mean, m)) OVER () AS z FROM minutes, (SELECT median(heart_rate_mean) AS m FROM minutes))", "minutes"))
def design_columns(spark, sf):
    minutes = Domain(spark, sf).minutes.select("encounter_key", "minute_index", F.col("heart_rate_mean").alias("heart_rate"))
    (_, z, _, by_minute), _ = stats.minute_design(minutes, ["heart_rate"])
    return minutes.select("encounter_key", F.col("minute_index").cast("long").alias("minute_index"), F.round(z, 6).alias("z"), F.round(by_minute, 5).alias("by_minute"))


#: A model of one two-valued term has closed forms: its coefficients are logits of the two shares.
_TWO = "(SELECT quality AS y, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS x, patient_key FROM predictions JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"
_SHARES = f"(SELECT avg(y) FILTER (x = 0) AS p0, avg(y) FILTER (x = 1) AS p1, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1, avg(y) AS p, count(*) AS n FROM {_TWO})"
_INFLUENCE = f"(SELECT patient_key, coalesce(sum(y - p0) FILTER (x = 0), 0) / any_value(n0 * p0 * (1 - p0)) AS i0, coalesce(sum(y - p1) FILTER (x = 1), 0) / any_value(n1 * p1 * (1 - p1)) AS i1 FROM {_TWO}, {_SHARES} GROUP BY 1)"


def _two(d: Domain) -> DataFrame:
    return d.predictions.join(d.table("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 2 == 0).cast("double").alias("x"), "patient_key")


@register("st3_logistic_fit", sql(f"SELECT 0 AS term, round(ln(p0 / (1 - p0)), 6) AS estimate FROM {_SHARES} UNION ALL SELECT 1, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 6) FROM {_SHARES}", "predictions"))
def logistic_fit(spark, sf):
    beta = stats.logistic_fit(_two(Domain(spark, sf)), [F.lit(1.0), F.col("x")], F.col("y"))
    return spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(beta)], "term int, estimate double")


@register("st3_gee", sql(f"SELECT 0 AS term, round(ln(p0 / (1 - p0)), 6) AS estimate, round(v0, 8) AS variance FROM {_SHARES}, (SELECT sum(i0 * i0) AS v0 FROM {_INFLUENCE}) UNION ALL SELECT 1, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 6), round(v1, 8) FROM {_SHARES}, (SELECT sum((i1 - i0) * (i1 - i0)) AS v1 FROM {_INFLUENCE})", "predictions"))
def gee(spark, sf):
    """Estimating equations with an independent working correlation, whose robust variance has a closed form."""
    fit = stats.gee(_two(Domain(spark, sf)), [F.lit(1.0), F.col("x")], F.col("y"), "patient_key", exchangeable=False)
    return spark.createDataFrame([(i, round(float(b), 6), round(float(fit.robust[i, i]), 8)) for i, b in enumerate(fit.beta)], "term int, estimate double, variance double")


@register("st4_tests", sql(f"SELECT 'wald' AS test, round(power(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 2) / v, 5) AS statistic, 1 AS degrees FROM {_SHARES}, (SELECT sum((i1 - i0) * (i1 - i0)) AS v FROM {_INFLUENCE}) UNION ALL SELECT 'score', round(u * u / v, 5), 1 FROM (SELECT sum(u1) AS u, sum(power(u1 - share * u0, 2)) AS v FROM (SELECT patient_key, sum(x * (y - p)) AS u1, sum(y - p) AS u0, any_value(n1 / n) AS share FROM {_TWO}, {_SHARES} GROUP BY 1))", "predictions"))
def tests(spark, sf):
    rows = _two(Domain(spark, sf))
    fit = stats.gee(rows, [F.lit(1.0), F.col("x")], F.col("y"), "patient_key", exchangeable=False)
    found = {"wald": stats.wald(fit, [1]), "score": stats.score_test(rows, [F.lit(1.0)], [F.col("x")], F.col("y"), "patient_key", exchangeable=False)}
    return spark.createDataFrame([(name, round(t[0], 5), t[1]) for name, t in found.items()], "test string, statistic double, degrees int")


def _components_sql(score: str) -> str:
    rank = lambda by: f"(rank() OVER ({by}ORDER BY {score}) + (count(*) OVER (PARTITION BY {'quality, ' if by else ''}{score}) - 1) / 2.0)"
    share = f"({rank('')} - {rank('PARTITION BY quality ')}) / (CASE WHEN quality = 1 THEN count(*) FILTER (quality = 0) OVER () ELSE count(*) FILTER (quality = 1) OVER () END)"
    return f"CASE WHEN quality = 1 THEN {share} ELSE 1 - {share} END"


@register("st7_delong", sql(f"SELECT round(a, 9) AS auc_a, round(b, 9) AS auc_b, round(a - b, 9) AS difference, round(sqrt(v), 9) AS standard_error, round((a - b) / sqrt(v), 6) AS z FROM (SELECT avg(va) FILTER (quality = 1) AS a, avg(vb) FILTER (quality = 1) AS b, var_samp(va - vb) FILTER (quality = 1) / count(*) FILTER (quality = 1) + var_samp(va - vb) FILTER (quality = 0) / count(*) FILTER (quality = 0) AS v FROM (SELECT quality, {_components_sql('deterioration_probability')} AS va, {_components_sql('other')} AS vb FROM (SELECT quality, deterioration_probability, doc_id % 17 / 17.0 AS other FROM predictions)))", "predictions"))
def delong(spark, sf):
    rows = Domain(spark, sf).predictions.select("quality", "deterioration_probability", (F.col("doc_id") % 17 / 17.0).alias("other"))
    found = stats.delong(rows, "quality", "deterioration_probability", "other")
    out = (round(found.auc_a, 9), round(found.auc_b, 9), round(found.difference, 9), round(found.standard_error, 9), round(found.z, 6))
    return spark.createDataFrame([out], "auc_a double, auc_b double, difference double, standard_error double, z double")


def _draws_sql(seed: int, group: str, resamples: int, source: str) -> str:
    u = f"CAST('0x' || substr(md5('{seed}:' || b || ':' || {group}), 1, 13) AS BIGINT) / {float(16**13)!r}"
    weight = " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in stats.poisson_bounds())
    return f"(SELECT * FROM (SELECT {group}, b, {weight} AS w FROM (SELECT {group}, b, {u} AS u FROM (SELECT DISTINCT {group} FROM {source}), range(0, {resamples}) AS resamples(b))) WHERE w > 0)"


def _bootstrap_sql(score: str) -> str:
    cells = f"(SELECT quality, patient_key, {score} AS s, count(*) AS n FROM (SELECT quality, patient_key, deterioration_probability, doc_id % 17 / 17.0 AS other FROM predictions) GROUP BY 1, 2, 3)"
    at = f"(SELECT b, s, CAST(sum(CASE WHEN quality = 1 THEN w * n ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN quality = 0 THEN w * n ELSE 0 END) AS DOUBLE) AS q FROM {cells} JOIN {_draws_sql(7, 'patient_key', stats.BOOTSTRAP_RESAMPLES, 'predictions')} USING (patient_key) GROUP BY 1, 2)"
    aucs = f"(SELECT b, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY b ORDER BY s) - q AS below FROM {at}) GROUP BY b HAVING sum(p) > 0 AND sum(q) > 0)"
    return f"SELECT '{score}' AS score, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM {aucs}"


@register("st8_group_bootstrap", sql(f"{_bootstrap_sql('deterioration_probability')} UNION ALL {_bootstrap_sql('other')}", "predictions"))
def group_bootstrap(spark, sf):
    rows = Domain(spark, sf).predictions.select("quality", "patient_key", "deterioration_probability", (F.col("doc_id") % 17 / 17.0).alias("other"))
    found = stats.group_bootstrap(rows, "quality", ["deterioration_probability", "other"], "patient_key", "other", stats.BOOTSTRAP_RESAMPLES, 7)
    return spark.createDataFrame([(n, round(v[0], 6), round(v[1], 6)) for n, v in found["intervals"].items()], "score string, low double, high double")


@register("st10_decisions", "SELECT * FROM (VALUES (0, true, true, 'gbt', true, 'age'), (1, false, false, '', false, ''), (2, false, true, 'gbt,naive', true, 'age,unit')) AS t(study, h1, h2, h2_models, h3, h3_moderators)")
def decisions(spark, sf):
    cases = [
        (0.01, 0.61, {"gbt": (0.1, 0.01), "naive": (0.1, 0.2)}, {"age": 0.02, "unit": 0.2}),
        (0.01, 0.49, {"gbt": (-0.1, 0.01), "naive": (0.1, 0.06)}, {"age": None, "unit": 0.05}),
        (0.2, 0.7, {"gbt": (0.1, 0.001), "naive": (0.2, 0.002)}, {"age": 0.001, "unit": 0.049}),
    ]
    rows = [(i, d["h1"], d["h2"], ",".join(d["h2_models"]), d["h3"], ",".join(d["h3_moderators"])) for i, d in enumerate(stats.decide(*c) for c in cases)]
    return Domain(spark, sf).spark.createDataFrame(rows, "study int, h1 boolean, h2 boolean, h2_models string, h3 boolean, h3_moderators string")


_POINTS = f"(SELECT t, e FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in study.TREND_SCALES)}) AS a(t), (VALUES {', '.join(f'({e}::DOUBLE)' for e in study.EVENT_SCALES)}) AS b(e))"
_SCORED = f"(SELECT t, e, quality AS y, round(t * (doc_id % 13) + e * quality * 3 + (doc_id % 7), 4) AS model, round(t * (doc_id % 5) + e * quality + (doc_id % 11), 4) AS news2 FROM predictions, {_POINTS})"


def _auc_sql(score: str) -> str:
    return f"(SELECT t, e, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS {score} FROM (SELECT t, e, y, rank() OVER (PARTITION BY t, e ORDER BY {score}) + (count(*) OVER (PARTITION BY t, e, {score}) - 1) / 2.0 AS r FROM {_SCORED}) GROUP BY 1, 2)"


def _points(d: Domain) -> DataFrame:
    grid = d.spark.createDataFrame([(t, e) for t in study.TREND_SCALES for e in study.EVENT_SCALES], "trend_scale double, event_scale double")
    rows = d.predictions.select("quality", "doc_id").crossJoin(F.broadcast(grid))  # thirty points, by definition
    t, e, k, y = F.col("trend_scale"), F.col("event_scale"), F.col("doc_id"), F.col("quality")
    return rows.select("trend_scale", "event_scale", y.alias("label"), F.round(t * (k % 13) + e * y * 3 + (k % 7), 4).alias("model"), F.round(t * (k % 5) + e * y + (k % 11), 4).alias("news2"))


@register("st11_calibration_grid", sql(f"SELECT t AS trend_scale, e AS event_scale, round(model, 9) AS model, round(news2, 9) AS news2 FROM {_auc_sql('model')} JOIN {_auc_sql('news2')} USING (t, e)", "predictions"))
def calibration_grid(spark, sf):
    return show(study.calibration_grid(_points(Domain(spark, sf))), ["trend_scale", "event_scale", "model", "news2"], 9)


@register("st11_calibration_choice", sql(f"SELECT t AS trend_scale, e AS event_scale, round(sqrt(power(model - 0.8, 2) + power(news2 - 0.7, 2)), 9) AS distance FROM {_auc_sql('model')} JOIN {_auc_sql('news2')} USING (t, e) ORDER BY sqrt(power(model - 0.8, 2) + power(news2 - 0.7, 2)), t, e LIMIT 1", "predictions"))
def calibration_choice(spark, sf):
    return show(study.calibration_choice(study.calibration_grid(_points(Domain(spark, sf)))), ["trend_scale", "event_scale", "distance"], 9)


_CELLS = "(SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS a, value FROM events)"


def _interaction_sql(weight: str) -> str:
    mean = lambda y, a: f"sum({weight} * value) FILTER (y = {y} AND a = {a}) / sum({weight}) FILTER (y = {y} AND a = {a})"
    return f"{mean(1, 1)} - {mean(0, 1)} - ({mean(1, 0)}) + {mean(0, 0)}"


@register("st12_interaction_bootstrap", f"SELECT round(estimate, 4) AS estimate, round(quantile_cont(i, 0.025), 4) AS lower, round(quantile_cont(i, 0.975), 4) AS upper FROM (SELECT b, {_interaction_sql('w')} AS i FROM {_CELLS} JOIN {_draws_sql(3, 'user_id', 200, 'events')} USING (user_id) GROUP BY b), (SELECT {_interaction_sql('1')} AS estimate FROM {_CELLS}) WHERE i IS NOT NULL GROUP BY estimate")
def interaction_bootstrap(spark, sf):
    e = Domain(spark, sf).table("events").select("user_id", (F.col("event_type") == "error").cast("int").alias("y"), (F.col("user_id") % 3 == 0).cast("int").alias("a"), "value")
    found = stats.interaction_bootstrap(e, "value", "y", "a", "user_id", 200, 3)
    return spark.createDataFrame([tuple(found.values())], "estimate double, lower double, upper double")

