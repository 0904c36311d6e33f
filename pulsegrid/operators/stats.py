"""Model evaluation and statistics: sums over executors, small algebra on the driver.

What reaches the driver has the size of the model (a few dozen numbers) or of a stated number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators.ranking import before, midranks


class StatisticsError(ValueError):
    """A statistic cannot be computed from these rows."""


# ---- distributions ----


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """The chance that a chi-square variable exceeds x: the upper incomplete gamma ratio, by series or fraction."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def holm(p_values: list[float]) -> list[float]:
    """Holm's step-down adjustment, in the order given."""
    order = sorted(range(len(p_values)), key=lambda i: p_values[i])
    out, worst = [0.0] * len(p_values), 0.0
    for k, i in enumerate(order):
        worst = max(worst, (len(p_values) - k) * p_values[i])
        out[i] = min(1.0, worst)
    return out


def holm_frame(df: DataFrame, p: str = "p_value", name: str = "holm_p_value") -> DataFrame:
    """Holm's adjustment as a column; for tables of tests, which are few."""
    from pyspark.sql import Window

    order = Window.orderBy(p)
    scaled = df.withColumn("_s", (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p))
    return scaled.withColumn(name, F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_s")


# ---- receiver operating characteristic ----


def auc_frame(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """(positives, negatives, auc) from midranks: ties count half. Null where a class is missing."""
    keys = list(group or [])
    ranked = midranks(df.where(F.col(score).isNotNull()), score, "_rank", keys)
    m, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.sum(F.when(F.col(label) == 1, F.col("_rank")))
    found = ranked.groupBy(*keys).agg(m.alias("positives"), n.alias("negatives"), total.alias("_t"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), (F.col("_t") - F.col("positives") * (F.col("positives") + 1) / 2.0) / (F.col("positives") * F.col("negatives")))
    return found.select(*keys, "positives", "negatives", value.alias("auc"))


def auc(df: DataFrame, label: str, score: str) -> float:
    row = auc_frame(df, label, score).first()
    if row is None or row.auc is None:
        raise StatisticsError("an AUC needs labels of both classes")
    return row.auc


@dataclass(frozen=True)
class DeLong:
    auc_a: float
    auc_b: float
    difference: float
    standard_error: float
    z: float
    p_value: float


def structural_components(df: DataFrame, label: str, score: str, name: str) -> DataFrame:
    """Adds each row's structural component: its rank among all less its rank within its class, per other row."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("_m"), F.count_if(F.col(label) == 0).alias("_n"))
    ranked = midranks(midranks(df, score, "_all"), score, "_own", [label]).crossJoin(F.broadcast(sizes))  # a single row
    share = (F.col("_all") - F.col("_own")) / F.when(F.col(label) == 1, F.col("_n")).otherwise(F.col("_m"))
    return ranked.withColumn(name, F.when(F.col(label) == 1, share).otherwise(1.0 - share)).drop("_all", "_own", "_m", "_n")


def delong(df: DataFrame, label: str, a: str, b: str) -> DeLong:
    """DeLong's two-sided test that two scores of the same rows have one AUC."""
    rows = structural_components(structural_components(df.select(label, a, b), label, a, "_va"), label, b, "_vb")
    found = {r[label]: r for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("_va").alias("ma"), F.avg("_vb").alias("mb"), F.var_samp("_va").alias("vaa"), F.var_samp("_vb").alias("vbb"), F.covar_samp("_va", "_vb").alias("vab")).collect()}
    if set(found) != {0, 1}:
        raise StatisticsError("an AUC needs labels of both classes")
    variance = sum((r.vaa + r.vbb - 2 * r.vab) / r.n for r in found.values())
    auc_a, auc_b = found[1].ma, found[1].mb
    difference = auc_a - auc_b
    if not variance > 1e-15:
        same = abs(difference) < 1e-15
        return DeLong(auc_a, auc_b, 0.0 if same else difference, 0.0, 0.0, 1.0 if same else 0.0)
    z = difference / math.sqrt(variance)
    return DeLong(auc_a, auc_b, difference, math.sqrt(variance), z, normal_two_sided(z))


#: Of the published analysis.
BOOTSTRAP_RESAMPLES = 2000


def poisson_weight(seed: int, resample: str, group: str) -> Column:
    """How often a group is drawn in a resample: Poisson(1) by a hash of the seed, the resample and the group."""
    u = C.hex_prefix_number(F.md5(F.concat_ws(":", F.lit(seed), F.col(resample), F.col(group).cast("string"))), 13) / F.lit(float(16**13))
    weight = F.lit(0)
    for bound in poisson_bounds():
        weight = weight + (u >= bound).cast("int")
    return weight


def poisson_bounds(terms: int = 12) -> list[float]:
    """The cumulative probabilities of Poisson(1)."""
    out, upto, p = [], 0.0, math.exp(-1)
    for k in range(terms):
        upto += p
        out.append(upto)
        p /= k + 1
    return out


def group_bootstrap(df: DataFrame, label: str, scores: list[str], group: str, reference: str, resamples: int, seed: int) -> dict:
    """Percentile 95% intervals of AUCs and of their differences from a reference, resampling whole groups.

    A group is drawn k times in a resample with k from a Poisson(1) hash, so every executor draws alike and no row
    moves to the driver; resamples with one class are skipped and counted.
    """
    found: dict[int, dict[str, float]] = {}
    draws = df.select(group).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", poisson_weight(seed, "_b", group)).where("_w > 0")
    for s in scores:
        cells = df.groupBy(label, group, s).agg(F.count(F.lit(1)).alias("_n"))  # rows of a cell are drawn alike
        weighted = cells.join(draws, group).withColumn("_w", F.col("_w") * F.col("_n"))
        for r in _weighted_auc(weighted, label, s).collect():  # one row for each resample
            if r.auc is not None:
                found.setdefault(r["_b"], {})[s] = r.auc
    if not found:
        raise StatisticsError("every bootstrap resample held one class")
    table = {s: np.array([f[s] for f in found.values()]) for s in scores}
    interval = lambda v: tuple(float(x) for x in np.percentile(v, [2.5, 97.5]))
    return {
        "intervals": {s: interval(v) for s, v in table.items()},
        "difference_intervals": {s: interval(v - table[reference]) for s, v in table.items() if s != reference},
        "resamples": resamples,
        "skipped": resamples - len(found),
    }


def _weighted_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    from pyspark.sql import Window

    at = df.groupBy("_b", score).agg(F.sum(F.when(F.col(label) == 1, F.col("_w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, F.col("_w")).otherwise(0)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = at.withColumn("_u", F.col("p") * (below + F.col("q") / 2.0))
    return rows.groupBy("_b").agg((F.sum("_u") / F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum("p") * F.sum("q"))).alias("auc"))


# ---- operating points ----


def operating_point(df: DataFrame, label: str, probability: str, threshold: float | Column) -> DataFrame:
    """One row: the confusion counts at a threshold, with sensitivity, specificity and balanced accuracy."""
    hit = F.col(probability) >= threshold
    y = F.col(label) == 1
    counts = df.agg(F.count_if(hit & y).alias("true_positive"), F.count_if(hit & ~y).alias("false_positive"), F.count_if(~hit & y).alias("false_negative"), F.count_if(~hit & ~y).alias("true_negative"))
    sens = F.coalesce(F.try_divide(F.col("true_positive"), F.col("true_positive") + F.col("false_negative")), F.lit(0.0))
    spec = F.coalesce(F.try_divide(F.col("true_negative"), F.col("true_negative") + F.col("false_positive")), F.lit(0.0))
    return counts.withColumns({"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2})


def youden(df: DataFrame, label: str, probability: str) -> DataFrame:
    """(threshold, j): the threshold in [0, 1] with the largest sensitivity + specificity - 1.

    Ties go to the one nearest one half, then the smaller. The curve is a running sum over distinct probabilities.
    """
    at = df.groupBy(F.col(probability).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    curve = before(at.where("threshold is not null"), [], "threshold", ["p", "q"], descending=True)
    every = at.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    curve = curve.crossJoin(F.broadcast(every))  # a single row
    curve = curve.select("threshold", ((F.col("p_before") + F.col("p")) / F.col("all_p") - (F.col("q_before") + F.col("q")) / F.col("all_q")).alias("j"))
    return curve.where("threshold between 0 and 1").orderBy(F.round("j", 12).desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


# ---- regressions from sums ----


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """The matrix of weighted sums of products of the columns: one aggregation, one row to the driver."""
    w = weight if weight is not None else F.lit(1.0)
    k = len(columns)
    named = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)), w.cast("double").alias("w"))
    sums = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    row = named.agg(*sums).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def ols(df: DataFrame, design: list[Column], target: Column) -> np.ndarray:
    """Least-squares coefficients from the normal equations."""
    g = gram(df, [*design, target])
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]


def linear(design: list[Column], beta: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, b in zip(design, beta.tolist(), strict=True):
        total = total + c.cast("double") * F.lit(b)
    return total


def _newton_sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hessian, gradient) of the log loss at beta, from rows (x0, ..., y, w) without nulls: one row of sums from each task.

    The coefficients change with each step, so as literals they would make Spark compile new code for each.
    """
    k = len(beta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x, y, w = table[:, :k], table[:, k], table[:, k + 1]
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
            h += (x * (w * p * (1.0 - p))[:, None]).T @ x
            g += x.T @ (w * (p - y))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([h.ravel(), g])], pa.list_(pa.float64()))], names=["s"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sum((b.column(0).flatten().to_numpy().reshape(-1, k * k + k).sum(axis=0) for b in batches if b.num_rows), np.zeros(k * k + k))
        yield pa.RecordBatch.from_arrays([pa.array([whole], pa.list_(pa.float64()))], names=["s"])

    found = np.array(rows.mapInArrow(part, "s array<double>").repartition(1).mapInArrow(total, "s array<double>").first().s)
    return found[: k * k].reshape(k, k), found[k * k :]


def logistic_fit(df: DataFrame, design: list[Column], label: Column, weight: Column | None = None, ridge: float = 0.0, iterations: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Newton's method on sum of weights * log loss + ridge / 2 * |beta|^2; each step is one pass. Rows with a null do not count."""
    w = weight if weight is not None else F.lit(1.0)
    names = [f"x{i}" for i in range(len(design))]
    rows = df.select(*(c.cast("double").alias(n) for c, n in zip(design, names, strict=True)), label.cast("double").alias("y"), w.cast("double").alias("w")).dropna().persist()
    beta = np.zeros(len(design))
    try:
        for _ in range(iterations):
            h, g = _newton_sums(rows, beta)
            step = np.linalg.solve(h + (ridge + 1e-12) * np.eye(len(design)), g + ridge * beta)
            beta = beta - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return beta


def _cluster_sums(df: DataFrame, names: list[str], cluster: str, mean: Column, binomial: bool) -> DataFrame:
    """Each cluster's sums for an exchangeable working correlation: A'R^-1A needs only sums and sums of products.

    With R = (1 - a) I + a J, its inverse is (I - c J) / (1 - a), so a cluster's matrices are combinations of
    sum(d d'), sum(d), sum(d e) and sum(e), where d are scaled derivatives and e scaled residuals.
    """
    rows = df.withColumn("_mu", mean)
    scale = F.sqrt(F.col("_mu") * (1.0 - F.col("_mu"))) if binomial else F.lit(1.0)
    rows = rows.withColumn("_s", scale).withColumn("_e", (F.col("y") - F.col("_mu")) / F.col("_s"))
    d = {n: F.col(n) * F.col("_s") for n in names}
    k = len(names)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_e").alias("e"), F.sum(F.col("_e") * F.col("_e")).alias("ee")]
    aggs += [F.sum(d[n]).alias(f"d{i}") for i, n in enumerate(names)] + [F.sum(d[n] * F.col("_e")).alias(f"g{i}") for i, n in enumerate(names)]
    aggs += [F.sum(d[names[i]] * d[names[j]]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy(cluster).agg(*aggs)


def _scores(per: DataFrame, alpha: float, k: int, upper: list[tuple[int, int]]) -> DataFrame:
    """Each cluster's score u and the upper triangle b of its sensitivity."""
    c = F.lit(alpha) / (1.0 + (F.col("n") - 1) * F.lit(alpha))
    g = [((F.col(f"g{i}") - c * F.col(f"d{i}") * F.col("e")) / (1.0 - alpha)).alias(f"u{i}") for i in range(k)]
    h = [((F.col(f"h{i}_{j}") - c * F.col(f"d{i}") * F.col(f"d{j}")) / (1.0 - alpha)).alias(f"b{i}_{j}") for i, j in upper]
    return per.select(*g, *h)


def _reduced_meat(scores: DataFrame, inverse: np.ndarray, upper: list[tuple[int, int]]) -> np.ndarray:
    """The sum of outer products of bias-reduced scores (Mancl and DeRouen, 2001).

    A cluster's residuals are divided by one less its leverage; by Woodbury's identity that turns its score u
    into (I - A M)^-1 u, with its sensitivity A and the inverse M of all clusters' sum, so sums suffice.
    """
    k = len(inverse)

    def batch(frames):
        for f in frames:
            u = f[[f"u{i}" for i in range(k)]].to_numpy()
            a = np.zeros((len(f), k, k))
            for i, j in upper:
                a[:, i, j] = a[:, j, i] = f[f"b{i}_{j}"].to_numpy()
            v = np.linalg.solve(np.eye(k) - a @ inverse, u[:, :, None])[:, :, 0]
            yield pd.DataFrame((v.T @ v).reshape(1, -1), columns=[f"m{x}" for x in range(k * k)])

    parts = scores.mapInPandas(batch, ", ".join(f"m{x} double" for x in range(k * k)))
    row = parts.agg(*(F.sum(f"m{x}").alias(f"m{x}") for x in range(k * k))).first()
    return np.array([row[f"m{x}"] for x in range(k * k)]).reshape(k, k)


@dataclass(frozen=True)
class Gee:
    beta: np.ndarray
    robust: np.ndarray
    alpha: float
    score: np.ndarray
    sensitivity: np.ndarray
    meat: np.ndarray


def gee(df: DataFrame, design: list[Column], target: Column, cluster: str, binomial: bool = True, exchangeable: bool = True, fixed: np.ndarray | None = None, iterations: int = 40, bias_reduced: bool = False) -> Gee:
    """Generalised estimating equations with an exchangeable (or independent) working correlation.

    Each iteration aggregates to one row of sums for each cluster and then to one row in all. fixed: evaluate
    the equations at these coefficients without fitting, which the score test needs. bias_reduced: a robust
    covariance for few clusters.
    """
    names = [f"x{i}" for i in range(len(design))]
    k = len(names)
    rows = df.select(*(c.cast("double").alias(n) for c, n in zip(design, names, strict=True)), target.cast("double").alias("y"), F.col(cluster).alias("_c")).persist()
    xs = [F.col(n) for n in names]
    beta = np.zeros(k) if fixed is None else np.array(fixed, float)
    alpha = 0.0
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(per: DataFrame, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = _scores(per, alpha, k, upper).agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(k)), *(F.sum(f"b{i}_{j}").alias(f"b{i}_{j}") for i, j in upper), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in upper)).first()
        bread, meat = np.zeros((k, k)), np.zeros((k, k))
        for i, j in upper:
            bread[i, j] = bread[j, i] = row[f"b{i}_{j}"]
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
        return np.array([row[f"u{i}"] for i in range(k)]), bread, meat

    try:
        for _ in range(iterations if fixed is None else 2):
            eta = linear(xs, beta)
            mean = 1.0 / (1.0 + F.exp(-eta)) if binomial else eta
            per = _cluster_sums(rows, names, "_c", mean, binomial).persist()
            if exchangeable:
                # moment estimator: mean product of residual pairs within clusters over the dispersion
                r = per.agg(F.sum("ee").alias("ee"), F.sum("n").alias("n"), F.sum((F.col("e") * F.col("e") - F.col("ee")) / 2).alias("pairs"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("np"), F.max("n").alias("most")).first()
                phi = r.ee / max(r.n - k, 1)
                lowest = -0.99 / max(r.most - 1, 1)  # below this the correlation matrix of the largest cluster is singular
                alpha = min(max(r.pairs / max(r.np - k, 1) / phi, lowest), 0.99) if r.np and phi > 0 else 0.0
            score, bread, meat = totals(per, alpha)
            step = np.linalg.solve(bread + 1e-12 * np.eye(k), score) if fixed is None else np.ones(k)
            done = fixed is None and np.abs(step).max() < 1e-8
            if done and bias_reduced:
                meat = _reduced_meat(_scores(per, alpha, k, upper), np.linalg.pinv(bread), upper)
            per.unpersist()
            if fixed is None:
                beta = beta + step
            if done:
                break
    finally:
        rows.unpersist()
    inverse = np.linalg.pinv(bread)
    return Gee(beta, inverse @ meat @ inverse, alpha, score, bread, meat)


def wald(fit: Gee, columns: list[int]) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) that the coefficients are all zero."""
    b = fit.beta[columns]
    statistic = float(b @ np.linalg.pinv(fit.robust[np.ix_(columns, columns)]) @ b)
    return statistic, len(columns), chi2_tail(statistic, len(columns))


def score_test(df: DataFrame, null: list[Column], extra: list[Column], target: Column, cluster: str, binomial: bool = True, exchangeable: bool = True) -> tuple[float, int, float]:
    """The generalised score test of extra terms: the full equations evaluated at the null fit, robust variance."""
    base = gee(df, null, target, cluster, binomial, exchangeable)
    at = gee(df, [*null, *extra], target, cluster, binomial, exchangeable, fixed=np.concatenate([base.beta, np.zeros(len(extra))]))
    a, b = list(range(len(null))), list(range(len(null), len(null) + len(extra)))
    project = at.sensitivity[np.ix_(b, a)] @ np.linalg.pinv(at.sensitivity[np.ix_(a, a)])
    u = at.score[b] - project @ at.score[a]
    m = at.meat
    v = m[np.ix_(b, b)] - project @ m[np.ix_(a, b)] - m[np.ix_(b, a)] @ project.T + project @ m[np.ix_(a, a)] @ project.T
    statistic = float(u @ np.linalg.pinv(v) @ u)
    return statistic, len(extra), chi2_tail(statistic, len(extra))


# ---- study helpers ----


def minute_design(minutes: DataFrame, vitals: list[str], minute: str = "minute_index") -> tuple[list[Column], dict[str, tuple[float, float, float]]]:
    """Intercept, standardised vitals, minute and vital-by-minute columns, with (median, mean, deviation) of each vital.

    The scaling is fitted on these rows: medians fill gaps, a zero deviation counts as one.
    """
    medians = minutes.agg(*(F.median(v).alias(v) for v in vitals)).first()
    filled = minutes.select(*(F.coalesce(F.col(v), F.lit(medians[v])).alias(v) for v in vitals))
    moments = filled.agg(*(F.avg(v).alias(f"{v}_m") for v in vitals), *(F.stddev_pop(v).alias(f"{v}_s") for v in vitals)).first()
    scaling = {v: (float(medians[v] or 0.0), float(moments[f"{v}_m"] or 0.0), float(moments[f"{v}_s"] or 0.0) or 1.0) for v in vitals}
    z = [(F.coalesce(F.col(v), F.lit(m)) - F.lit(a)) / F.lit(s) for v, (m, a, s) in scaling.items()]
    t = F.col(minute).cast("double")
    return [F.lit(1.0), *z, t, *(x * t for x in z)], scaling


def heart_rate_rise(minutes: DataFrame, keep: list[str], scoring_minute: int = 14, early: int = 5) -> DataFrame:
    """Each encounter's heart rate in the scoring minute less its mean in the first minutes; only where both exist."""
    found = minutes.groupBy("encounter_key", *keep).agg(
        F.max(F.when(F.col("minute_index") == scoring_minute, F.col("heart_rate"))).alias("late"), F.avg(F.when(F.col("minute_index") < early, F.col("heart_rate"))).alias("early")
    )
    return found.where("late is not null and early is not null").select("encounter_key", *keep, (F.col("late") - F.col("early")).alias("rise"))


def window_rise(readings: DataFrame, key: str, time: str, value: str, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """Mean of late seconds less mean of early seconds since each key's first reading."""
    start = readings.groupBy(key).agg(F.min(time).alias("_start"))
    rows = readings.join(start, key).withColumn("_at", C.seconds_between(F.col("_start"), F.col(time)))
    mean = lambda w: F.avg(F.when((F.col("_at") >= w[0]) & (F.col("_at") < w[1]), F.col(value)))
    return rows.groupBy(key).agg((mean(late) - mean(early)).alias("rise"))


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): whole groups dealt to folds so that classes stay balanced.

    Groups are ordered by their number of positives and of rows, then a seeded hash, and dealt to and fro over the
    folds; they are numbered by ranges, not in one task.
    """
    sizes = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")))
    placed = before(sizes.select(group, F.struct(-F.col("p"), -F.col("n"), shuffled, F.col(group)).alias("_order"), F.lit(1).alias("_one")), [], "_order", ["_one"])
    at = F.col("_one_before")
    lap, place = F.floor(at / folds), at % folds
    return placed.select(group, F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold"))


def decide(signal_p: float, gee_low: float, comparisons: dict[str, tuple[float, float]], moderation: dict[str, float], alpha: float = 0.05) -> dict:
    """The study's rules: H1 needs the test and an interval above one half, H2 and H3 adjusted p below alpha."""
    h2 = tuple(n for n, (difference, p) in comparisons.items() if difference > 0 and p < alpha)
    h3 = tuple(n for n, p in moderation.items() if p is not None and p < alpha)
    return {"h1": signal_p < alpha and gee_low > 0.5, "h2": bool(h2), "h2_models": h2, "h3": bool(h3), "h3_moderators": h3}


def interaction_bootstrap(rows: DataFrame, value: str, label: str, older: str, cluster: str, resamples: int, seed: int) -> dict[str, float]:
    """The label-by-age interaction of least squares with a cluster bootstrap interval.

    With both factors and their product in the model, the interaction is the difference of the label's effects on
    the four cells' means. Clusters reduce to sums in these cells and are drawn by hash; the driver sees one row
    for each resample. A resample in which a cell is empty is skipped.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(cluster, F.col(label).cast("int").alias("_y"), F.col(older).cast("int").alias("_a")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))

    def interaction(df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
        mean = lambda y, a: F.sum(F.when((F.col("_y") == y) & (F.col("_a") == a), weight * F.col("_s"))) / F.sum(F.when((F.col("_y") == y) & (F.col("_a") == a), weight * F.col("_n")))
        return df.groupBy(*keys).agg((mean(1, 1) - mean(0, 1) - mean(1, 0) + mean(0, 0)).alias("interaction"))

    estimate = interaction(cells, [], F.lit(1)).first().interaction
    draws = cells.select(cluster).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", poisson_weight(seed, "_b", cluster)).where("_w > 0")
    found = [r.interaction for r in interaction(cells.join(draws, cluster), ["_b"], F.col("_w")).collect() if r.interaction is not None]
    if estimate is None or not found:
        raise StatisticsError("an interaction needs rows in all four cells")
    low, high = np.percentile(found, [2.5, 97.5])
    return {"estimate": round(float(estimate), 4), "lower": round(float(low), 4), "upper": round(float(high), 4)}
