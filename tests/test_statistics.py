"""Statistics and the model against numpy, and quality, history, cohort and simulation operators."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import lineage
from pulsegrid.functions.catalog import MODEL_FEATURES
from pulsegrid.operators import cohort, model, quality, ranking, scd, simulate, stats
from pulsegrid.sources import readers

rng = np.random.default_rng(4)
N = 240
X = rng.standard_normal((N, 2))
Y = (rng.random(N) < 1 / (1 + np.exp(-(0.3 + 1.2 * X[:, 0] - 0.7 * X[:, 1])))).astype(int)
A, B = np.round(X[:, 0], 1), np.round(X[:, 0] * 0.4 + rng.standard_normal(N), 1)
G = np.arange(N) // 6


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(int(Y[i]), float(A[i]), float(B[i]), f"g{G[i]:02d}", float(X[i, 0]), float(X[i, 1])) for i in range(N)], "y int, a double, b double, g string, x0 double, x1 double").cache()


def slow_auc(y, s):
    p, q = s[y == 1][:, None], s[y == 0][None, :]
    return ((p > q) + 0.5 * (p == q)).mean()


def test_auc_and_delong(rows):
    assert stats.auc(rows, "y", "a") == pytest.approx(slow_auc(Y, A))
    got = stats.delong(rows, "y", "a", "b")

    def parts(s):
        p, q = s[Y == 1][:, None], s[Y == 0][None, :]
        psi = (p > q) + 0.5 * (p == q)
        return psi.mean(axis=1), psi.mean(axis=0)

    (a1, a0), (b1, b0) = parts(A), parts(B)
    variance = np.var(a1 - b1, ddof=1) / len(a1) + np.var(a0 - b0, ddof=1) / len(a0)
    assert got.difference == pytest.approx(a1.mean() - b1.mean()) and got.standard_error == pytest.approx(math.sqrt(variance))
    same = stats.delong(rows.withColumn("c", F.col("a")), "y", "a", "c")
    assert (same.difference, same.p_value) == (0.0, 1.0)
    with pytest.raises(stats.StatisticsError):
        stats.auc(rows.where("y = 1"), "y", "a")


def test_bootstrap(rows):
    got = stats.group_bootstrap(rows, "y", ["a", "b"], "g", "b", 60, 1)
    low, high = got["intervals"]["a"]
    assert low < slow_auc(Y, A) < high and high - low < 0.3 and got["skipped"] == 0 and got == stats.group_bootstrap(rows, "y", ["a", "b"], "g", "b", 60, 1)


def test_the_bootstrap_query_draws_all_resamples(spark, monkeypatch):
    from pulsegrid.plans import modelling, registry

    drawn, whole = [], stats.group_bootstrap
    monkeypatch.setattr(modelling.stats, "group_bootstrap", lambda *given: drawn.append(whole(*given)) or drawn[-1])
    rows = {r.score: (r.low, r.high) for r in registry.QUERIES["st8_group_bootstrap"](spark, "/root/testdata/sf0.001").collect()}
    assert drawn[0]["resamples"] == 2000 and drawn[0]["skipped"] < 20 and rows == {s: tuple(round(x, 6) for x in v) for s, v in drawn[0]["intervals"].items()}


def test_distributions_and_holm(spark):
    for x, k, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (23.684791304840576, 14, 0.05), (0.0, 3, 1.0), (100, 2, math.exp(-50))):
        assert stats.chi2_tail(x, k) == pytest.approx(p, rel=1e-9)
    assert stats.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    got = stats.holm_frame(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p_value double")).orderBy("i").collect()
    assert [r.holm_p_value for r in got] == pytest.approx([0.03, 0.06, 0.06])
    assert stats.decide(0.01, 0.6, {"m": (0.1, 0.01), "n": (-0.1, 0.01)}, {"age": 0.2, "unit": 0.01}) == {"h1": True, "h2": True, "h2_models": ("m",), "h3": True, "h3_moderators": ("unit",)}


def newton(x, y, ridge=0.0, w=None):
    beta, w = np.zeros(x.shape[1]), np.ones(len(y)) if w is None else w
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), x.T @ (w * (p - y)) + ridge * beta)
    return beta


def test_regressions(rows):
    design = [F.lit(1.0), F.col("x0"), F.col("x1")]
    x = np.column_stack([np.ones(N), X])
    assert stats.logistic_fit(rows, design, F.col("y")) == pytest.approx(newton(x, Y), abs=1e-6)
    assert stats.ols(rows, design, F.col("b")) == pytest.approx(np.linalg.lstsq(x, B, rcond=None)[0], abs=1e-9)


def slow_gee(x, y, g, binomial):
    beta, alpha, k = np.zeros(x.shape[1]), 0.0, x.shape[1]
    for _ in range(60):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta)) if binomial else eta
        s = np.sqrt(mu * (1 - mu)) if binomial else np.ones(len(y))
        e = (y - mu) / s
        phi = (e**2).sum() / (len(y) - k)
        pairs = sum((e[g == c].sum() ** 2 - (e[g == c] ** 2).sum()) / 2 for c in np.unique(g))
        count = sum((g == c).sum() * ((g == c).sum() - 1) / 2 for c in np.unique(g))
        alpha = pairs / (count - k) / phi
        u, bread, meat = 0, 0, 0
        for c in np.unique(g):
            d, r = x[g == c] * s[g == c][:, None], e[g == c]
            inverse = np.linalg.inv((1 - alpha) * np.eye(len(r)) + alpha)
            uc = d.T @ inverse @ r
            u, bread, meat = u + uc, bread + d.T @ inverse @ d, meat + np.outer(uc, uc)
        step = np.linalg.solve(bread, u)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta, np.linalg.inv(bread) @ meat @ np.linalg.inv(bread), alpha


def slow_reduced(x, y, g, binomial, beta, alpha):
    eta = x @ beta
    mu = 1 / (1 + np.exp(-eta)) if binomial else eta
    s = np.sqrt(mu * (1 - mu)) if binomial else np.ones(len(y))
    parts = []
    for c in np.unique(g):
        d, e = x[g == c] * s[g == c][:, None], ((y - mu) / s)[g == c]
        parts.append((d, e, np.linalg.inv((1 - alpha) * np.eye(len(e)) + alpha)))
    m = np.linalg.inv(sum(d.T @ v @ d for d, _, v in parts))
    u = [d.T @ v @ np.linalg.solve(np.eye(len(e)) - d @ m @ d.T @ v, e) for d, e, v in parts]
    return m @ sum(np.outer(a, a) for a in u) @ m


@pytest.mark.parametrize("binomial", [True, False])
def test_gee_equals_dense_algebra(rows, binomial):
    x, y = np.column_stack([np.ones(N), X]), Y if binomial else B
    beta, robust, alpha = slow_gee(x, y, G, binomial)
    fit = stats.gee(rows, [F.lit(1.0), F.col("x0"), F.col("x1")], F.col("y" if binomial else "b"), "g", binomial)
    assert fit.beta == pytest.approx(beta, abs=1e-5) and fit.alpha == pytest.approx(alpha, abs=1e-5) and np.allclose(fit.robust, robust, rtol=1e-3)
    reduced = stats.gee(rows, [F.lit(1.0), F.col("x0"), F.col("x1")], F.col("y" if binomial else "b"), "g", binomial, bias_reduced=True)
    assert np.allclose(reduced.robust, slow_reduced(x, y, G, binomial, beta, alpha), rtol=1e-3)
    statistic, df, p = stats.wald(fit, [1, 2])
    assert df == 2 and 0 <= p < 0.05 and statistic > 6


def test_score_test_sees_a_signal_and_no_noise(rows):
    noisy = rows.withColumn("z", F.xxhash64("x0") % 1000 / 1000.0)
    assert stats.score_test(rows, [F.lit(1.0)], [F.col("x0"), F.col("x1")], F.col("y"), "g")[2] < 1e-4
    assert stats.score_test(noisy, [F.lit(1.0)], [F.col("z")], F.col("y"), "g")[2] > 0.01


def test_model_round_trip(spark):
    data = []
    for i in range(160):
        f = rng.standard_normal(len(MODEL_FEATURES))
        data.append((f"e{i:03d}", f"p{i % 40}", "train" if i % 4 else "test", "f1", "l1", int(f[0] + 0.3 * rng.standard_normal() > 0.2), *(None if i % 17 == 0 and j == 1 else float(v) for j, v in enumerate(f))))
    kinds = "encounter_key string, patient_key string, data_split string, feature_schema_version string, label_definition_version string, deterioration_proxy_label int, " + ", ".join(f"{c} double" for c in MODEL_FEATURES)
    frame = spark.createDataFrame(data, kinds).cache()
    fitted = model.train(frame)
    again = model.train(frame.repartition(3))
    p = fitted["parameters"]
    assert again["manifest"]["dataset_fingerprint"] == fitted["manifest"]["dataset_fingerprint"] and again["parameters"]["coefficients"] == pytest.approx(p["coefficients"])
    train = [r for r in data if r[2] == "train"]
    x = np.array([[np.nan if v is None else v for v in r[6:]] for r in train])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    y = np.array([r[5] for r in train])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    assert model.coefficients(p) == pytest.approx(newton(z, y, 1.0, w), abs=1e-5)
    found = model.evaluate(frame, p)
    assert found["roc_auc"] > 0.9 and 0 <= found["threshold"] <= 1
    blobs = model.pack(fitted, found["threshold"])
    version = p["model_version"]
    assert model.load(blobs, version)[0] == p
    for name, change in (("parameters.json", b"{}"), ("manifest.json", b"{}")):
        with pytest.raises(model.ContractError):
            model.load(blobs | {name: change}, version)
    with pytest.raises(model.ContractError):
        model.load(blobs, "other")
    out = model.predict(frame, p, found["threshold"], "2024-01-01 00:00:00")
    assert out.where("predicted_label = 1 and deterioration_probability < decision_threshold").count() == 0 and out.count() == 160
    for bad in (frame.limit(0), frame.where("data_split = 'train'"), frame.drop("spo2_min")):
        with pytest.raises(model.ContractError):
            model.validate_training(bad)
    model.validate_scoring(frame, fitted["manifest"])
    with pytest.raises(model.ContractError):
        model.validate_scoring(frame.withColumn("feature_schema_version", F.lit("f2")), fitted["manifest"])
    assert model.scoring_frame(spark, p).count() == 12
    trees = model.boosted_trees(frame, list(MODEL_FEATURES[:3]), "deterioration_proxy_label", iterations=3)
    assert trees.getNumTrees == 3


def test_minutes(spark):
    minutes = spark.createDataFrame([("e", m, 60.0 + m if m != 3 else None, "s") for m in range(15)], "encounter_key string, minute_index int, heart_rate double, split_group string")
    assert stats.heart_rate_rise(minutes, ["split_group"]).first().rise == pytest.approx(74 - np.mean([60, 61, 62, 64]))
    design, scaling = stats.minute_design(minutes, ["heart_rate"])
    assert len(design) == 4 and scaling["heart_rate"][0] == pytest.approx(67.5)
    readings = minutes.select("encounter_key", F.timestamp_add("MINUTE", F.col("minute_index"), F.lit("2024-01-01").cast("timestamp")).alias("t"), "heart_rate")
    assert stats.window_rise(readings, "encounter_key", "t", "heart_rate", (0, 120), (720, 900)).first().rise == pytest.approx(73 - 60.5)
    folds = {r.split_group: r.fold for r in stats.stratified_group_folds(spark.createDataFrame([(f"g{i}", i % 2) for i in range(20)], "split_group string, y int"), "split_group", "y").collect()}
    assert len(folds) == 20 and sorted(list(folds.values()).count(k) for k in range(5)) == [4] * 5
    study = spark.createDataFrame([(f"p{i}", i % 2, (i // 2) % 2, 1.0 + 2 * (i % 2) - 4.0 * (i % 2) * ((i // 2) % 2)) for i in range(80)], "p string, y int, old int, rise double")
    assert stats.interaction_bootstrap(study, "rise", "y", "old", "p", 50, 1)["estimate"] == pytest.approx(-4.0)


def test_ranks(spark):
    frame = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 5)], "v double")
    got = {r.fraction: r.v for r in ranking.distributed_nearest_rank(frame, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 0.95: 3.0, 1.0: 5.0}
    gated = ranking.gate_interval(spark.createDataFrame([("a", float(t)) for t in (0, 5, 299, 300, 310, 900)], "k string, t double"), "k", "t", 300, suppress_first=True)
    assert sorted(r.t for r in gated.collect()) == [0.0, 300.0, 900.0]


def test_quality(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert quality.table_fingerprint(frame).first() == quality.table_fingerprint(frame.repartition(3).orderBy(F.desc("k"))).first()
    assert quality.table_fingerprint(frame).first() != quality.table_fingerprint(frame.withColumn("v", F.lit("c"))).first()
    report = {r.rule: r.passed for r in quality.check(frame, quality.Contract([quality.not_null("k"), quality.not_in_set("v", ["a"])], 4, [("k",)])).collect()}
    assert report == {"row_count": False, "not_null:k": True, "not_in_set:v": False, "unique:k": False}
    training = spark.createDataFrame([("p1", "train", 1), ("p1", "test", 0), ("p2", "train", 1)], "patient_key string, data_split string, deterioration_proxy_label int")
    assert [r[0] for r in quality.split_leakage(training).collect()] == ["p1"] and quality.missing_split(training).count() == 0 and quality.missing_split(training.where("data_split = 'train'")).count() == 1
    assert quality.one_class_splits(training).count() == 2
    scored = spark.createDataFrame([("m", "e", 1.5, 0.5), ("m", "f", 0.5, 0.5)], "model_version string, encounter_key string, deterioration_probability double, decision_threshold double")
    assert [r.encounter_key for r in quality.out_of_unit_range(scored).collect()] == ["e"]
    path = tmp_path / "plan"
    path.write_text("x")
    digest = quality.file_gate(path, "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")
    assert digest.startswith("2d71")
    with pytest.raises(ValueError):
        quality.file_gate(path, "0" * 64)


def test_history(spark):
    with pytest.raises(scd.DuplicateKeys):
        h = spark.createDataFrame([], "provider_npi string, provider_name string, taxonomy_code string, taxonomy_description string, provider_state string, valid_from string, valid_to string, is_current string, data_source string")
        scd.merge_snapshot(h, spark.createDataFrame([("1", "a", "t", "d", "s")] * 2, ", ".join(f"{f} string" for f in scd.SNAPSHOT_FIELDS)), "2024-01-01")
    got = scd.versions_from_changes(spark.createDataFrame([("n", "2020"), ("n", "2022")], "npi string, on string"), "npi", "on").orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.is_current) for r in got] == [("2020", "2022", False), ("2022", None, True)]
    claims = spark.createDataFrame([("p", "A", "2020"), ("p", "A", "2021"), ("p", None, "2022"), ("p", "A", "2023")], "patient_id string, payer string, start string")
    periods = scd.periods(claims, "patient_id", "payer", "start", keys=spark.createDataFrame([("p",), ("q",)], "patient_id string"))
    assert sorted(tuple(r) for r in periods.collect() if r.valid_to) == [("p", "A", "2020", "2022"), ("p", "No insurance", "2022", "2023")]
    assert sorted(tuple(r)[:3] for r in periods.collect() if not r.valid_to) == [("p", "A", "2023"), ("q", "No insurance", "1900-01-01")]


def test_cohort(spark):
    npi = {"identifier": {"system": cohort.NPI, "value": "123"}}
    encounter = lambda i, cls, **more: {"resource": {"resourceType": "Encounter", "id": i, "class": {"code": cls}, "serviceProvider": {"reference": f"Organization?id|f{i}", "display": f"F{i}", "identifier": {"value": f"f{i}"}}, **more}}
    condition = lambda code, visit: {"resource": {"resourceType": "Condition", "code": {"coding": [{"system": cohort.SNOMED, "code": code, "display": f"{code} (disorder)"}]}, "encounter": {"reference": f"urn:uuid:{visit}"}}}
    full = encounter(
        "9", "IMP", subject={"reference": "Patient/p1"}, period={"start": "2024-01-01T08:00:00Z", "end": "2024-01-02T08:00:00Z"}, reasonCode=[{"coding": [{"code": "c", "display": "d"}], "text": "synthea_history"}],
        location=[{"location": {"display": "Ward"}}], identifier=[{"system": "sim", "value": "run1:p1"}], meta={"tag": [{"system": "scn", "code": "normal"}]}, participant=[{"type": [{"coding": [{"code": "ATND"}]}], "individual": npi}],
    )
    pressure = {"resource": {"resourceType": "Observation", "id": "b", "code": {"coding": [{"code": "85354-9"}]}, "component": [{"code": {"coding": [{"code": "8480-6"}]}, "valueQuantity": {"value": 120}}, {"code": {"coding": [{"code": "8462-4"}]}, "valueQuantity": {"value": 80}}]}}
    patient = {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1950-01-01", "gender": "male", "extension": [{"url": cohort.RACE, "extension": [{"url": "text", "valueString": "R"}]}], "address": [{"state": "WA"}]}}
    claim = {"resource": {"resourceType": "ExplanationOfBenefit", "billablePeriod": {"start": "2020-01-05T00:00:00Z"}, "insurer": {"display": "A"}}}
    bundle = json.dumps({"entry": [patient, encounter("1", "AMB"), encounter("2", "EMER"), condition("10", "1"), condition("20", "2"), condition("10", "2"), full, pressure, claim]})
    bundles = spark.createDataFrame([("p1", bundle)], "patient_id string, value string")
    take = lambda kind, schema: readers.bundle_resources(bundles, kind, schema)
    people = cohort.patients(take("Patient", cohort.PATIENT).drop("id")).first()
    assert (people.birth_date, people.race, people.ethnicity, people.state) == ("1950-01-01", "R", None, "WA")
    profile = cohort.admission_profile(take("Encounter", cohort.ENCOUNTER), take("Condition", cohort.CONDITION)).first()
    assert [f.id for f in profile.facilities] == ["f2", "f9"] and [d.code for d in profile.diagnoses] == ["10", "20"] and [d.code for d in profile.hospital_diagnoses] == ["20", "10"]
    admissions = cohort.admission_rows(take("Encounter", cohort.ENCOUNTER), "sim", "scn").collect()
    assert len(admissions) == 1 and (admissions[0].patient_id, admissions[0].run_id, admissions[0].scenario, admissions[0].attending_npi, admissions[0].unit) == ("p1", "run1", "normal", "123", "Ward")
    assert tuple(cohort.blood_pressures(take("Observation", cohort.OBSERVATION)).first()) == ("p1", "b", 120.0, 80.0)
    assert tuple(cohort.payer_history(take("ExplanationOfBenefit", cohort.CLAIM)).first()) == ("p1", "A", "2020-01-05", None)
    assert cohort.recent_encounters(take("Encounter", cohort.ENCOUNTER)).first().id == "9"
    groups = {r.position: (r.split_group, r.epoch) for r in cohort.split_groups(spark.createDataFrame([("a", 1), ("b", 53), ("c", 54)], "patient_id string, position int")).join(spark.createDataFrame([("a", 1), ("b", 53), ("c", 54)], "patient_id string, position int"), "patient_id").collect()}
    assert groups == {1: ("bidmc01", 0), 53: ("bidmc53", 0), 54: ("bidmc01", 1)}
    organizations = spark.createDataFrame([("f1", "One", "c", "s"), ("f2", "Two", "c", "s")], "facility_id string, facility_name string, city string, state string")
    used = spark.createDataFrame([("f1",), (cohort.FALLBACK_FACILITY[0],)], "facility_id string")
    assert sorted(r.facility_id for r in cohort.facilities(organizations, used).collect()) == ["f1", cohort.FALLBACK_FACILITY[0]]
    with pytest.raises(ValueError):
        cohort.cohort(bundles.withColumn("path", F.lit("x")), 2)
    assert cohort.sanitised(organizations, ("city",)).columns == ["facility_id", "facility_name", "state"]


def test_simulation(spark):
    people = spark.createDataFrame([(f"p{i}",) for i in range(60)], "patient_id string")
    first = {r.patient_id: r.scenario for r in simulate.choose_scenarios(people, "s").collect()}
    prior = spark.createDataFrame(list(first.items()), "patient_id string, scenario string")
    second = {r.patient_id: r.scenario for r in simulate.choose_scenarios(people, "s", prior).collect()}
    assert set(first.values()) == set(simulate.SCENARIOS) and all(first[p] != second[p] for p in first)
    runs = simulate.balanced_runs(people, "s").groupBy("patient_id", "scenario").count().collect()
    assert {r["count"] for r in runs} == {3}
    readings = people.crossJoin(spark.createDataFrame([(t, sc) for t in (0, 899, 900, 1799, 1800) for sc in simulate.SCENARIOS], "elapsed int, scenario string")).withColumns({"run_id": F.lit("r1"), "heart_rate": F.lit(104.0), "spo2": F.lit(99.0)})
    out = simulate.apply_scenario(readings, "s").collect()
    for r in out:
        inside = 900 <= r.elapsed < 1800
        if not inside:
            assert r.heart_rate == 104.0
        elif r.scenario == "normal":
            assert r.heart_rate == 96.0
        else:
            assert 131 <= r.heart_rate <= 150 and 85 <= r.spo2 <= 91
    planned = simulate.precursors(readings.withColumn("age_65_plus", F.lit(True)), "s", 1.0, {"heart_rate": (8.0, 0.0)}, older_multiplier=2.0)
    drifted = simulate.apply_precursor(planned, 300, 600).where("scenario = 'deterioration'").collect()
    assert {(r.elapsed, r.heart_rate) for r in drifted} == {(0, 104.0), (899, 120.0), (900, 104.0), (1799, 104.0), (1800, 104.0)}
    waves = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "record int, offset_seconds int, heart_rate double")
    placed = simulate.waveform_rows(waves, spark.createDataFrame([("a", 1), ("b", 54)], "patient_id string, position int"))
    at0 = {r.patient_id: r.heart_rate for r in placed.where("offset_seconds = 0").collect()}
    assert at0 == {"a": 0.0, "b": 5.0}
    stays = people.withColumns({"run_id": F.lit("r"), "facilities": F.array(F.lit("f1"), F.lit("f2")), "diagnoses": F.array().cast("array<string>"), "fallback_diagnoses": F.array(F.lit("d1"))})
    plan = simulate.plan_admissions(stays, "s").collect()
    assert {r.facility for r in plan} == {"f1", "f2"} and {r.diagnosis_source for r in plan} == {"simulator_fallback"} and all(24 <= r.length_of_stay_hours <= 144 and 0 <= r.admit_hour < 24 for r in plan)
    versions = spark.createDataFrame([("n1", "t1", "WA", "2020-01-01", None), ("n2", "t1", "WA", "2020-01-01", "2023-01-01"), ("n3", "t1", "OR", "2020-01-01", None)], "provider_npi string, taxonomy_code string, provider_state string, valid_from string, valid_to string").withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})
    admitted = spark.createDataFrame([("e1", "p1", "r", "U")], "encounter_id string, patient_id string, run_id string, unit string").withColumn("admitted_on", F.lit("2024-01-01").cast("date"))
    assert simulate.choose_attendings(admitted, versions, spark.createDataFrame([("U", "t1")], "unit string, taxonomy_code string"), "s").first().attending_npi == "n1"
    assert simulate.batch_cycles(spark, people.limit(1), "s", "2024-01-01").count() == 6 * 360


def test_lineage(tmp_path):
    path = tmp_path / "events"
    with lineage.run(lineage.file_emitter(str(path)), "job", ["a"], ["b"]):
        pass
    with pytest.raises(KeyError), lineage.run(lineage.file_emitter(str(path)), "job", [], []):
        raise KeyError
    assert [json.loads(line)["eventType"] for line in path.read_text().splitlines()] == ["START", "COMPLETE", "START", "FAIL"]

    def broken(_):
        raise OSError

    with lineage.run(broken, "job", [], []):
        pass
    assert lineage.model_edges({"gold": ["silver", "seed"]}) == [("seed", "gold"), ("silver", "gold")]


def test_study(spark):
    from pulsegrid.operators import study

    local = np.random.default_rng(11)
    encounters, minutes = [], []
    for e in range(60):
        label, old = e % 2, (e // 2) % 2
        encounters.append((f"e{e}", f"g{e // 2}", label, old, "22298006" if e % 3 else "1734006", "207RC0000X" if e % 5 else "207RP1001X"))
        base = 70 + 3 * local.standard_normal()
        for m in range(15):
            rate = base + 0.6 * m * label * (1 - 0.9 * old) + local.standard_normal()
            minutes.append((f"e{e}", m, rate, 15 + local.standard_normal() + label, 97 - 0.3 * label + 0.2 * local.standard_normal(), 120.0 + local.standard_normal() if m % 5 == 0 else None, 37.0 + 0.1 * local.standard_normal() if m % 5 == 0 else None, 21.0 if m % 5 == 0 else None, 0.0 if m == 5 else None))
    frame = spark.createDataFrame(encounters, "encounter_key string, split_group string, label int, old int, diagnosis_code string, attending_taxonomy_code string").withColumns({"news2_total": F.lit(1), "age_at_admission_years": F.when(F.col("old") == 1, 70).otherwise(50)})
    chosen = study.analysis_set(frame, ["1734006"])
    assert {r.diagnosis_group for r in chosen.collect()} == {"Cardiovascular", "Other"} and {r.specialty_group for r in chosen.collect()} == {"Cardiology", "Critical care and pulmonary"}
    with pytest.raises(Exception, match="admitting list"):
        study.analysis_set(frame, []).collect()
    raw = spark.createDataFrame(minutes, "encounter_key string, minute_index int, heart_rate_mean double, respiratory_rate_mean double, spo2_mean double, systolic_bp_mean double, temperature_mean double, inhaled_oxygen_concentration_max double, consciousness_level_max double")
    rows = study.minute_frame(raw, chosen).cache()
    assert rows.where("consciousness_level is null").agg(F.max("minute_index")).first()[0] == 4 and rows.where("systolic_bp is null").count() == 0
    folds = stats.stratified_group_folds(chosen, "split_group", "label", 3)
    scores = study.out_of_fold_scores(rows, folds, ("heart_rate", "respiratory_rate"))
    assert scores.count() == 60 and stats.auc(scores, "label", "gee_logistic") > 0.7 and stats.auc(scores, "label", "naive_logistic") > 0.7
    assert study.vital_signal_test(rows, vitals=("heart_rate", "respiratory_rate")).p_value < 0.01
    tests = study.moderation_tests(rows, moderators=("age_65_plus", "diagnosis_group"))
    assert tests["age_65_plus"].holm_p_value < 0.001 < tests["diagnosis_group"].holm_p_value
    assert study.rise_moderation_tests(rows, moderators=("age_65_plus",))["age_65_plus"].p_value < 0.001
    grid = spark.createDataFrame([(1.0, 1.0, 0.7, 0.6), (2.0, 1.0, 0.81, 0.7)], "trend_scale double, event_scale double, model double, news2 double")
    assert study.calibration_choice(grid).first().trend_scale == 2.0 and study.power([0.01, 0.2]) == 0.5


def test_training_split_by_groups(spark):
    from pulsegrid.functions.catalog import FEATURE_COLUMNS
    from pulsegrid.operators import features

    rows = spark.createDataFrame([(f"e{i}", f"p{i}") for i in range(40)], "encounter_key string, patient_id string")
    rows = rows.withColumns({"patient_key": F.md5("patient_id"), "provider_version_key": F.lit("v"), "is_training_eligible": F.lit(True), "deterioration_proxy_label": F.lit(0), "label_definition_version": F.lit("l"), **{c: F.lit(1.0) for c in FEATURE_COLUMNS}})
    groups = rows.select("patient_id", F.concat(F.lit("g"), F.substring("patient_id", 2, 1)).alias("split_group")).where("patient_id <> 'p39'")
    out = features.training_dataset(rows, groups)
    joined = out.join(groups.select(F.md5("patient_id").alias("patient_key"), "split_group"), "patient_key")
    assert out.count() == 40 and quality.split_leakage(joined, "split_group").count() == 0 and joined.select("data_split").distinct().count() == 2
