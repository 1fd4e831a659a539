"""Outcome summaries, paired differences, bootstrap, AUC and ROC, logistic calibration, least squares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.ranges import running
from granary.session import stored


def outcome_shares(df: DataFrame, keys: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """keys, n, accuracy (gold), flip (attack), both, other; no keys and no rows give NaN shares."""
    n = F.count("*")
    share = lambda kind: F.when(n > 0, F.count_if(F.col(outcome) == kind) / n).otherwise(float("nan"))
    return df.groupBy(*keys).agg(n.alias("n"), share("gold").alias("accuracy"), share("attack").alias("flip"), share("both").alias("both"), share("other").alias("other"))


def paired(df: DataFrame, keys: Sequence[str], arm: str, a: str, b: str, value: Column) -> DataFrame:
    """keys, value_a, value_b, diff for the keys that both arms have: one shuffle, no self-join."""
    of = lambda name: F.max(F.when(F.col(arm) == name, value))
    out = df.filter(F.col(arm).isin(a, b)).groupBy(*keys).agg(of(a).alias("value_a"), of(b).alias("value_b"))
    return out.filter("value_a IS NOT NULL AND value_b IS NOT NULL").withColumn("diff", F.col("value_a") - F.col("value_b"))


def cluster_components(df: DataFrame, cluster: str, values: dict[str, Column]) -> DataFrame:
    """cluster, s_<name>, n_<name>: sums and numbers of each value where it isn't null, which is all that ratio-of-sums
    statistics and their bootstrap need."""
    wide = df.select(F.col(cluster), *[c.alias(f"v_{k}") for k, c in values.items()])
    sums = [x for k in values for x in (F.coalesce(F.sum(f"v_{k}"), F.lit(0.0)).alias(f"s_{k}"), F.count(f"v_{k}").alias(f"n_{k}"))]
    return wide.groupBy(cluster).agg(*sums)


def shifts(df: DataFrame, unit: Sequence[str], arm: str, hit: Column, named: dict[str, tuple[Sequence[str], str, Column]]) -> DataFrame:
    """unit columns and a column for each name: the hits of arms less those of the base, where both answered the unit.

    named: name -> (arms, base, which units count). Pooled arms are averaged over those that answered, weighing one each,
    so a unit that two arms answered is two differences: columns are <name>, their sum, and <name>_times, their number."""
    held = {a for arms, base, _ in named.values() for a in (*arms, base)}
    per = df.filter(F.col(arm).isin(*held)).groupBy(*unit).agg(*[F.max(F.when(F.col(arm) == a, hit.cast("double"))).alias(f"at_{i}") for i, a in enumerate(sorted(held))])
    place = {a: F.col(f"at_{i}") for i, a in enumerate(sorted(held))}
    out = []
    for name, (arms, base, counts) in named.items():
        diffs = F.filter(F.array(*[F.when(counts, place[a] - place[base]) for a in arms]), lambda d: d.isNotNull())
        out += [F.aggregate(diffs, F.lit(0.0), lambda x, d: x + d).alias(name), F.size(diffs).cast("bigint").alias(f"{name}_times")]
    return per.select(*unit, *out)


def shift_components(units: DataFrame, cluster: str, names: Sequence[str]) -> DataFrame:
    """cluster, s_<name>, n_<name> of the columns that shifts() makes."""
    return units.groupBy(cluster).agg(*[x for k in names for x in (F.sum(k).alias(f"s_{k}"), F.sum(f"{k}_times").alias(f"n_{k}"))])


def _names(components: DataFrame) -> list[str]:
    return [c[2:] for c in components.columns if c.startswith("s_")]


def estimates(components: DataFrame, statistics: dict[str, str]) -> DataFrame:
    """statistic, estimate, n_clusters: SQL expressions over the components' ratios of sums, by their names."""
    means = components.agg(*[F.try_divide(F.sum(f"s_{k}").cast("double"), F.sum(f"n_{k}").cast("double")).alias(k) for k in _names(components)], F.count("*").alias("n_clusters"))
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), F.expr(e).cast("double").alias("estimate")) for k, e in statistics.items()])
    return means.select(F.explode(rows).alias("x"), "n_clusters").select("x.statistic", "x.estimate", "n_clusters")


def replicates(components: DataFrame, cluster: str, resamples: int, seed: str) -> DataFrame:
    """rep and a mean for each component: clusters drawn with replacement, stored.

    A cluster's numbers of draws are Poisson(1), from a generator that seed and cluster start; so a replicate needs no
    state, each partition adds up its own clusters for all replicates, and only these sums meet."""
    names = _names(components)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2 * len(names), resamples))
        for part in batches:
            parts = part[[f"{x}_{k}" for k in names for x in "sn"]].to_numpy(float)
            for key, row in zip(part["key"], parts, strict=True):
                start = int.from_bytes(hashlib.sha256(f"{seed}|{key}".encode()).digest()[:16], "big")
                total += np.outer(row, np.random.Generator(np.random.PCG64(start)).poisson(1.0, resamples))
        yield pd.DataFrame({"rep": np.arange(resamples), **{f"{x}_{k}": total[2 * i + j] for i, k in enumerate(names) for j, x in enumerate("sn")}})

    columns = [f"{x}_{k}" for k in names for x in "sn"]
    rows = components.select(F.col(cluster).cast("string").alias("key"), *[F.col(c).cast("double") for c in columns])
    sums = rows.mapInPandas(run, "rep bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])
    return stored(sums.select("rep", *[F.when(F.col(f"n_{k}") > 0, F.col(f"s_{k}") / F.col(f"n_{k}")).alias(k) for k in names]), "replicates")


def cluster_bootstrap(components: DataFrame, cluster: str, statistics: dict[str, str], resamples: int = 2000, seed: str = "boot", alphas: Sequence[float] = (0.05,)) -> DataFrame:
    """statistic, alpha, estimate, n_clusters, lo, hi: percentile intervals of statistics of several components, all from
    the same replicates; replicates in which a component has no cluster don't count for statistics of it."""
    reps = replicates(components, cluster, resamples, seed)
    ends = [x for a in alphas for x in (a / 2, 1 - a / 2)]
    wide = reps.agg(*[F.percentile(F.expr(e).cast("double"), F.array(*[F.lit(float(q)) for q in ends])).alias(f"q{i}") for i, e in enumerate(statistics.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), F.lit(float(a)).alias("alpha"), F.get(f"q{i}", F.lit(2 * j)).alias("lo"), F.get(f"q{i}", F.lit(2 * j + 1)).alias("hi")) for i, k in enumerate(statistics) for j, a in enumerate(alphas)])
    ci = wide.select(F.explode(rows).alias("x")).select("x.*")
    return estimates(components, statistics).join(F.broadcast(ci), "statistic").select("statistic", "alpha", "estimate", "n_clusters", "lo", "hi")


def samples_bootstrap(rows: DataFrame, row_id: str, samples: dict[str, Column], statistics: dict[str, str], **more) -> DataFrame:
    """cluster_bootstrap of rows drawn one by one: a proportion is one sample, the difference of two independent ones two
    samples whose columns are null in each other's rows."""
    return cluster_bootstrap(cluster_components(rows, row_id, samples), row_id, statistics, **more)


def paired_bootstrap(diffs: Sequence[float], resamples: int = 2000, seed: int = 0, alpha: float = 0.05) -> dict:
    """The exact resampler for few differences: n, diff, lo, hi, significant."""
    d = np.asarray(diffs, float)
    if not len(d):
        return {"n": 0, "diff": float("nan"), "lo": float("nan"), "hi": float("nan"), "significant": False}
    means = d[np.random.default_rng(seed).integers(0, len(d), size=(resamples, len(d)))].mean(axis=1)
    lo, hi = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return {"n": len(d), "diff": float(d.mean()), "lo": float(lo), "hi": float(hi), "significant": bool(lo > 0 or hi < 0)}


def verdict(direction: Column, lo: Column, hi: Column) -> Column:
    """supported or refuted if the interval is on one side of zero, else inconclusive."""
    side = F.when(lo > 0, 1).when(hi < 0, -1).otherwise(0)
    return F.when(side == 0, "inconclusive").when(side == direction, "supported").otherwise("refuted")


def by_score(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, score, pos, neg: rows merged by score, so that ranks need no sort of single rows."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_pos, n_neg, auc with average ranks for ties; NaN if a class is missing. Scores are ranked in ranges."""
    per = running(by_score(df, label, score, keys), [*keys, "score"], {"upto": "neg"}, "auc-scores")
    under = (F.col("upto") - F.col("neg")).cast("double")
    out = per.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * under + F.col("neg"))).alias("wins2"), F.min(under).alias("base"))
    wins2 = F.col("wins2") - 2 * F.col("base") * F.col("n_pos")  # what stands before the group isn't of it
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), wins2 / (2.0 * F.col("n_pos") * F.col("n_neg"))).otherwise(float("nan")).alias("auc"))


def roc(df: DataFrame, label: str, score: str, max_points: int = 200) -> DataFrame:
    """point, fpr, tpr: a point per distinct score from the highest on, (0, 0) first, thinned evenly to max_points."""
    per = running(by_score(df, label, score), [F.col("score").desc()], {"p": "pos", "q": "neg", "point": F.lit(1).cast("bigint")}, "roc-scores")
    whole = per.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nq"), F.count("*").alias("m"))
    rows = per.join(F.broadcast(whole)).select("point", "m", (F.col("q") / F.col("nq")).alias("fpr"), (F.col("p") / F.col("np")).alias("tpr"))
    zero = whole.filter("m > 0").select(F.lit(0).cast("bigint").alias("point"), "m", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    rows = rows.unionByName(zero)
    k = F.least(F.lit(max_points), F.col("m") + 1)
    step = F.col("m") / (k - 1)
    hit = F.ceil(F.col("point") / step)
    kept = (k - 1 >= F.col("m")) | (F.floor(hit * step) == F.col("point"))
    return rows.filter(kept).select(F.col("point").cast("bigint").alias("point"), F.round("fpr", 4).alias("fpr"), F.round("tpr", 4).alias("tpr"))


class Calibrator:
    """Logistic model over standardised features."""

    def __init__(self, features: Sequence[str], w, b: float, mean, std):
        self.features, self.w, self.b, self.mean, self.std = list(features), list(map(float, w)), float(b), list(map(float, mean)), list(map(float, std))

    def probability(self) -> Column:
        z = F.lit(self.b)
        for name, w, m, s in zip(self.features, self.w, self.mean, self.std, strict=True):
            z = z + F.lit(w) * (F.col(name) - m) / s
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def to_dict(self) -> dict:
        return {"features": self.features, "w": self.w, "b": self.b, "mean": self.mean, "std": self.std}

    @classmethod
    def from_dict(cls, d: dict) -> Calibrator:
        return cls(d["features"], d["w"], d["b"], d["mean"], d["std"])


def fit_calibrators(df: DataFrame, label: str, models: dict[str, tuple[Sequence[str], str | None]], masks: dict[str, Column] | None = None, l2: float = 1e-2, rounds: int = 50) -> dict[str, Calibrator]:
    """Many models in one scan a step: {name: (features, mask or None)}, fitted to the rows that the mask lets through.

    Damped Newton steps: each one pass over the stored rows adds up gradient and Hessian of every model that hasn't settled;
    only their d^2 numbers reach the driver. Population deviations (1 for constant features), L2 on all weights but the bias,
    ridge 1e-6, steps cut to 5."""
    masks = {k: F.coalesce(v, F.lit(False)) for k, v in (masks or {}).items()} | {"": F.lit(True)}
    names, kinds = sorted({c for used, _ in models.values() for c in used}), sorted(masks)
    rows = stored(df.select(F.col(label).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.array(*[masks[k] for k in kinds]).alias("m")), "calibration")
    held = lambda i, k: F.when(F.col("m")[k], F.col("x")[i])
    wanted = sorted({(names.index(c), kinds.index(mask or "")) for used, mask in models.values() for c in used})
    moments = rows.agg(*[f(held(*w)) for w in wanted for f in (F.avg, F.stddev_pop)]).first() if wanted else []
    scale = {w: (float("nan") if moments[2 * i] is None else moments[2 * i], moments[2 * i + 1] or 0.0) for i, w in enumerate(wanted)}
    plan = {}
    for name, (used, mask) in models.items():
        at, k = [names.index(c) for c in used], kinds.index(mask or "")
        mean, std = (np.array([scale[i, k][j] for i in at], float) for j in (0, 1))
        plan[name] = (at, k, mean, np.where(std < 1e-12, 1.0, std))
    theta, open_ = {name: np.zeros(len(used) + 1) for name, (used, _) in models.items()}, list(models)

    def sums(batches):
        total = {}
        for part in batches:
            if not len(part):
                continue
            x, y, m = np.array(part["x"].tolist(), float).reshape(len(part), -1), part["y"].to_numpy(float), np.array(part["m"].tolist(), bool)
            for name in now:
                at, k, mean, std = plan[name]
                mine = m[:, k]
                z = np.column_stack(((x[mine][:, at] - mean) / std, np.ones(int(mine.sum()))))
                p = 1.0 / (1.0 + np.exp(-np.clip(z @ now[name], -30, 30)))
                both = np.concatenate((z.T @ (p - y[mine]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))
                total[name] = total.get(name, 0.0) + both
        for name, both in total.items():
            yield pd.DataFrame({"model": name, "at": np.arange(len(both)), "value": both})

    for _ in range(rounds):
        now = {name: theta[name] for name in open_}
        got = {name: np.zeros(len(t) * (len(t) + 1)) for name, t in now.items()}
        for r in rows.mapInPandas(sums, "model string, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect():
            got[r["model"]][r["at"]] = r["value"]
        for name in list(open_):
            d = len(theta[name])
            reg = np.array([l2] * (d - 1) + [0.0])
            step = np.clip(np.linalg.solve(got[name][d:].reshape(d, d) + np.diag(reg) + 1e-6 * np.eye(d), got[name][:d] + reg * theta[name]), -5, 5)
            theta[name] = theta[name] - step
            if np.abs(step).max() < 1e-8:
                open_.remove(name)
        if not open_:
            break
    if not all(np.isfinite(t).all() for t in theta.values()):
        raise FloatingPointError("the calibration diverged; raise l2")
    return {name: Calibrator(used, theta[name][:-1], theta[name][-1], plan[name][2], plan[name][3]) for name, (used, _) in models.items()}


def fit_calibrator(df: DataFrame, label: str, features: Sequence[str], l2: float = 1e-2, rounds: int = 50) -> Calibrator:
    """One model of fit_calibrators, over all rows."""
    return fit_calibrators(df, label, {"one": (features, None)}, None, l2, rounds)["one"]


def auc_by_model(df: DataFrame, label: str, models: dict[str, tuple[Calibrator, Column]], digits: int = 9) -> DataFrame:
    """model, n_pos, n_neg, auc of each calibrator over the rows that its column lets through, all in one pass."""
    each = F.array_compact(F.array(*[F.when(rows, F.struct(F.lit(name).alias("model"), F.round(model.probability(), digits).alias("p"))) for name, (model, rows) in models.items()]))
    return auc(df.select(F.col(label).alias("y"), F.explode(each).alias("x")).select("y", "x.model", "x.p"), "y", "p", ["model"])


def r_squared(df: DataFrame, target: str, features: Sequence[str]) -> float:
    """R^2 of least squares with intercept, from sums of products."""
    names = [*features, "_one"]
    rows = df.select(F.col(target).cast("double").alias("_t"), *[F.col(c).cast("double") for c in features], F.lit(1.0).alias("_one"))
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("_t")) for a in names] + [F.sum(F.col("_t") * F.col("_t"))]
    got = list(map(float, rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()))
    d, xtx, k = len(names), np.zeros((len(names), len(names))), 0
    for i in range(d):
        for j in range(i, d):
            xtx[i, j] = xtx[j, i] = got[k]
            k += 1
    xty, tt, n = np.array(got[k : k + d]), got[-1], xtx[-1, -1]
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    return float(1 - (tt - 2 * beta @ xty + beta @ xtx @ beta) / (tt - xty[-1] ** 2 / n))


def max_normalized(score: Column, keys: Sequence[str], floor: float = 0.1) -> Column:
    """score / largest of the group, at least floor and at most 1; all 1 where the largest is 0."""
    most = F.max(score).over(Window.partitionBy(*keys))
    return F.when(most <= 1e-12, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), score / most)))


def min_shifted(score: Column, keys: Sequence[str]) -> Column:
    """(score - smallest) / (largest - smallest); all 1 where they are equal."""
    group = Window.partitionBy(*keys)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def clipped(score: Column, floor: float = 0.1) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), score))
