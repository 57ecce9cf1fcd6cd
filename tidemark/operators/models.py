"""Models fitted for all folds in one job.

Input: dealt rows (folds.dealt) with fold, is_train, features and a target. A linear model needs only sums over each
fold's training rows: one aggregate gives every fold's Gram matrix, the driver solves k x k systems, and predictions are
column arithmetic on weights that come back as a table of a row a fold. Rows without a target aren't fitted but
predicted; unknown features count as `fill`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cross_section import finite, pearson, spearman


def _x(f: str, fill: float) -> Column:
    return F.coalesce(F.col(f).cast("double"), F.lit(fill))


def gram(rows: DataFrame, features: Sequence[str], target: str, fill: float = 0.5) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
    """fold -> n, means, centred second moments (k x k), centred products with y, mean of y, over rows with a target.

    Two passes, means first, so that nothing cancels. At most k(k+3)/2 aggregates: for k beyond about 30 split features
    into blocks.
    """
    fit = rows.filter(F.col("is_train") & finite(target).isNotNull()).select("fold", finite(target).alias("_y"), *[_x(f, fill).alias(f"_x{i}") for i, f in enumerate(features)])
    k = len(features)
    means = fit.groupBy("fold").agg(*[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k)], F.avg("_y").alias("_my"))
    fixed = fit.sparkSession.createDataFrame(means.collect(), means.schema)
    c = fit.join(F.broadcast(fixed), "fold")
    d = lambda i: F.col(f"_x{i}") - F.col(f"_m{i}")
    sums = [F.sum(d(i) * d(j)).alias(f"_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(d(i) * (F.col("_y") - F.col("_my"))).alias(f"_y{i}") for i in range(k)]
    out = {}
    for r in c.groupBy("fold", "_my", *[f"_m{i}" for i in range(k)]).agg(F.count("*").alias("_n"), *sums).collect():
        s = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                s[i, j] = s[j, i] = r[f"_{i}_{j}"]
        out[r["fold"]] = (r["_n"], np.array([r[f"_m{i}"] for i in range(k)]), s, np.array([r[f"_y{i}"] for i in range(k)]), r["_my"])
    return out


@dataclass
class Linear:
    """Per fold: centre, scale and weight of each feature, and a constant."""

    features: list[str]
    folds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]
    fill: float = 0.5

    def table(self, spark) -> DataFrame:
        rows = [(int(f), n, float(m), float(s), float(w), float(c)) for f, (mu, sd, ws, c) in sorted(self.folds.items()) for n, m, s, w in zip(self.features, mu, sd, ws, strict=True)]
        return spark.createDataFrame(rows, "fold int, input string, centre double, scale double, weight double, constant double")

    def predict(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        flat = [(int(f), *[float(v) for v in (*(w / sd), float(c - (w / sd) @ mu))]) for f, (mu, sd, w, c) in sorted(self.folds.items())]
        k = len(self.features)
        table = rows.sparkSession.createDataFrame(flat, "fold int, " + ", ".join(f"_w{i} double" for i in range(k)) + ", _c double")
        total = F.col("_c")
        for i, f in enumerate(self.features):
            total = total + F.col(f"_w{i}") * _x(f, self.fill)
        return rows.join(F.broadcast(table), "fold").withColumn(name, total).drop("_c", *[f"_w{i}" for i in range(k)])


def ridge(rows: DataFrame, features: Sequence[str], target: str = "y_z", alpha: float = 1.0, intercept: bool = False, prior: Mapping[str, float] | None = None, fill: float = 0.5) -> Linear:
    """Ridge on features standardised by population moments; alpha is per row. With a prior direction d the weights
    shrink towards c d, c being the slope of y on that direction, instead of towards zero."""
    folds = {}
    for f, (n, mu, s, xy, my) in gram(rows, features, target, fill).items():
        sd = np.sqrt(np.diag(s) / n) + 1e-9
        z, zy, w0 = s / np.outer(sd, sd), xy / sd, np.zeros(len(sd))
        if prior:
            d = np.array([prior.get(x, 0.0) for x in features])
            along = d @ z @ d
            w0 = d * (d @ zy / along) if along > 0 else w0
        w = np.linalg.solve(z + alpha * n * np.eye(len(sd)), zy + alpha * n * w0)
        folds[f] = (mu, sd, w, my if intercept else 0.0)
    return Linear(list(features), folds, fill)


def composite(rows: DataFrame, features: Sequence[str], target: str = "y_z", signs: Mapping[str, float] | None = None, learn: bool = True, least: float = 0.0, fill: float = 0.5) -> Linear:
    """Equal weights with signs given beforehand or learned from the training correlation, if it reaches `least`."""
    signs, fit = dict(signs or {}), rows.filter(F.col("is_train") & finite(target).isNotNull())
    aggs = [F.count("*").alias("_n")]
    for i, f in enumerate(features):
        aggs += [F.avg(_x(f, fill)).alias(f"_m{i}"), F.stddev_pop(_x(f, fill)).alias(f"_s{i}"), pearson(_x(f, fill), finite(target)).alias(f"_c{i}")]
    folds = {}
    for r in fit.groupBy("fold").agg(*aggs).collect():
        w = np.zeros(len(features))
        for i, f in enumerate(features):
            c = r[f"_c{i}"] or 0.0
            w[i] = np.sign(signs[f]) if f in signs else np.sign(c) if learn and abs(c) >= least else 0.0
        folds[r["fold"]] = (np.array([r[f"_m{i}"] for i in range(len(features))]), np.array([r[f"_s{i}"] for i in range(len(features))]) + 1e-9, w / np.abs(w).sum() if w.any() else w, 0.0)
    return Linear(list(features), folds, fill)


#: The quantiles at which a rule may switch.
QUANTILES = tuple(round(0.1 * k, 1) for k in range(1, 10))


def rule(rows: DataFrame, features: Sequence[str], ret: str = "y", position: float = -1.0, quantiles: Sequence[float] = QUANTILES, min_on: float = 0.2, margin: float | str = 0.0, periods: int = 252, fill: float = 0.5) -> DataFrame:
    """A row a fold: input (-1: always in), threshold, above, sharpe, always, best, margin, candidates.

    Every threshold of every input on either side is a candidate. A row is summed once an input, at its place among the
    thresholds; candidates then add up places. The best replaces being always in only if it beats it by the margin.
    """
    fit = rows.filter(F.col("is_train") & finite(ret).isNotNull()).select("fold", (finite(ret) * position).alias("_r"), *[_x(f, fill).alias(f"_x{i}") for i, f in enumerate(features)])
    cuts = fit.groupBy("fold").agg(*[F.percentile(f"_x{i}", F.array(*[F.lit(float(q)) for q in quantiles])).alias(f"_q{i}") for i in range(len(features))])
    cuts = fit.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # a row a fold
    root = F.lit(float(np.sqrt(periods)))
    sharpe = lambda c: F.try_divide(F.avg(c), F.stddev_samp(c)) * root
    always = fit.groupBy("fold").agg(sharpe(F.col("_r")).alias("always"), F.count("*").alias("_n"))
    # where each value lies among its fold's thresholds: how many are below it, and how many not above it

    def place(i: int) -> Column:
        x, edges = F.col(f"_x{i}"), F.col(f"_q{i}")
        return F.struct(F.lit(i).alias("input"), F.size(F.filter(edges, lambda t: t < x)).alias("a"), F.size(F.filter(edges, lambda t: t <= x)).alias("b"))

    places = [place(i) for i in range(len(features))]
    placed = fit.join(F.broadcast(cuts), "fold").select("fold", "_r", F.explode(F.array(*places)).alias("c")).select("fold", "_r", "c.*")
    sums = placed.groupBy("fold", "input", "a", "b").agg(F.count("*").alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r") * F.col("_r")).alias("q"))
    each = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(k).alias("k"), F.get(f"_q{i}", F.lit(k)).alias("t"), F.lit(above).alias("above")) for i in range(len(features)) for k in range(len(quantiles)) for above in (True, False)])
    cands = cuts.select("fold", F.explode(each).alias("c")).select("fold", "c.*")
    on = F.when(F.col("above"), F.col("a") > F.col("k")).otherwise(F.col("b") <= F.col("k"))
    total = lambda c: F.sum(F.when(on, F.col(c)).otherwise(0))
    scored = sums.join(F.broadcast(cands), ["fold", "input"]).groupBy("fold", "input", "k", "t", "above").agg(F.sum("n").alias("_all"), total("n").alias("_on"), total("s").alias("_s"), total("q").alias("_q"))
    spread = F.try_divide(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_all"), F.col("_all") - 1)  # off is a return of nought
    scored = scored.select("fold", "input", "k", "t", "above", (F.col("_on") / F.col("_all")).alias("share"), F.when(spread > 1e-300, F.col("_s") / F.col("_all") / F.sqrt(spread) * root).alias("sharpe"))
    kept = scored.filter(F.col("share") >= min_on)
    # first of equals: by input, then quantile, above before below
    best = kept.groupBy("fold").agg(F.count("*").alias("_k"), F.max_by(F.struct("input", "t", "above", "sharpe"), F.struct("sharpe", -F.col("input"), -F.col("k"), "above")).alias("b"))
    out = always.join(best, "fold", "left")
    if margin == "deflated":
        from .judge import expected_max_sharpe

        found = {(r["_n"], r["_k"] or 0) for r in out.select("_n", "_k").distinct().collect()}
        table = out.sparkSession.createDataFrame([(n, k, expected_max_sharpe(k + 1, 1 / max(n, 2)) * float(np.sqrt(periods))) for n, k in found], "_n bigint, _k2 bigint, margin double")
        out = out.withColumn("_k2", F.coalesce("_k", F.lit(0).cast("bigint"))).join(F.broadcast(table), ["_n", "_k2"])
    else:
        out = out.withColumn("margin", F.lit(float(margin)))
    lead = F.coalesce(F.col("b.sharpe") - F.col("always") > F.col("margin"), F.lit(False))
    return out.select(
        "fold", F.when(lead, F.col("b.input")).otherwise(-1).alias("input"), F.when(lead, F.col("b.t")).otherwise(0.0).alias("threshold"), F.when(lead, F.col("b.above")).alias("above"),
        F.when(lead, F.col("b.sharpe")).otherwise(F.col("always")).alias("sharpe"), "always", F.col("b.sharpe").alias("best"), "margin", (F.coalesce("_k", F.lit(0)) + 1).cast("bigint").alias("candidates"),
    )


def rule_predict(rows: DataFrame, fitted: DataFrame, features: Sequence[str], position: float = -1.0, fill: float = 0.5, name: str = "pred") -> DataFrame:
    x = F.coalesce(*[F.when(F.col("input") == i, _x(f, fill)) for i, f in enumerate(features)])
    on = F.when(F.col("input") < 0, True).when(F.col("above"), x > F.col("threshold")).otherwise(x < F.col("threshold"))
    picked = fitted.select("fold", "input", "threshold", "above")
    return rows.join(F.broadcast(picked), "fold").withColumn(name, F.when(on, F.lit(float(position))).otherwise(0.0)).drop("input", "threshold", "above")


def boosted(rows: DataFrame, features: Sequence[str], target: str = "y_z", seeds: Sequence[int] = (0,), trees: int = 20, depth: int = 3, rate: float = 0.1, fill: float = 0.5) -> tuple[DataFrame, dict]:
    """Gradient-boosted trees by pyspark.ml, one distributed fit for each fold and seed, predictions averaged over
    seeds. Returns the predictions and each fold's mean importances. Stands where a single-machine booster would; its
    numbers differ from such a one's."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [f"_x{i}" for i in range(len(features))]
    filled = rows.withColumns({n: _x(f, fill) for n, f in zip(names, features, strict=True)})
    vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(filled).drop(*names).cache()
    out, gains = None, {}
    for fold in sorted(r[0] for r in vectors.select("fold").distinct().collect()):
        own = vectors.filter(F.col("fold") == fold)
        fit = own.filter(F.col("is_train") & finite(target).isNotNull()).withColumn("_t", finite(target))
        total, gain = F.lit(0.0), np.zeros(len(features))
        for k, seed in enumerate(seeds):
            model = GBTRegressor(featuresCol="_v", labelCol="_t", predictionCol=f"_p{k}", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(fit)
            own, total = model.transform(own), total + F.col(f"_p{k}") / len(seeds)
            gain += model.featureImportances.toArray() / len(seeds)
        own = own.withColumn("pred", total).drop("_v", *[f"_p{k}" for k in range(len(seeds))])
        out, gains[fold] = own if out is None else out.unionByName(own), dict(zip(features, map(float, gain), strict=True))
    return out, gains


def check_predictions(preds: DataFrame, date: str = "t0", cross_section: bool = True, allow_constant: bool = False) -> None:
    """Raises where a prediction is constant on a test date, or over a fold's test period for a time series."""
    test = preds.filter(~F.col("is_train"))
    if cross_section:
        days = test.groupBy("fold", date).agg(F.stddev_samp("pred").alias("sd"))
        r = days.agg(F.count("sd").alias("n"), F.min("sd").alias("least"), F.min_by("fold", "sd").alias("fold")).first()
        if not r["n"]:
            raise AssertionError("one row a date: a time series needs cross_section=False")
        if not r["least"] > 0:
            raise AssertionError(f"fold {r['fold']}: the prediction is constant on a test date")
    elif not allow_constant:
        r = test.groupBy("fold").agg(F.stddev_pop("pred").alias("sd")).filter("not sd > 0").limit(1).collect()
        if r:
            raise AssertionError(f"fold {r[0]['fold']}: the prediction is constant over the test period")


def in_sample_ic(preds: DataFrame, target: str = "y_rank", date: str = "t0", cross_section: bool = True) -> DataFrame:
    """fold, is_ic: mean over training dates of the rank correlation, or the pooled one."""
    train = preds.filter("is_train")
    if not cross_section:
        return spearman(train, "pred", target, ["fold"], "is_ic").select("fold", "is_ic")
    return spearman(train, "pred", target, ["fold", date]).groupBy("fold").agg(F.avg("ic").alias("is_ic"))


def stability(weights: DataFrame, signed: bool = True) -> DataFrame:
    """weights: fold, input, weight. Per input: folds, mean, mean_abs, sign_agreement (null where all are zero)."""
    w = F.col("weight")
    up, down = F.count_if(w > 0), F.count_if(w < 0)
    agree = F.when((up + down > 0) & F.lit(signed), F.greatest(up, down) / F.count("*"))
    return weights.groupBy("input").agg(F.count("*").alias("folds"), F.avg(w).alias("mean"), F.avg(F.abs(w)).alias("mean_abs"), agree.alias("sign_agreement"))


def zscore_ensemble(members: Sequence[DataFrame], weights: Sequence[float], keys: Sequence[str], date: str = "t0", cross_section: bool = True) -> DataFrame:
    """Weighted mean of the members' standardised predictions: keys, fold, is_train, pred.

    Standardised within (date, fold, is_train), or for a time series by the fold's training moments. Members are
    stacked and summed in one aggregate, not joined one by one; each row must be in every member.
    """
    from pyspark.sql import Window

    if not members or len(members) != len(weights):
        raise ValueError("one weight for each member")
    parts = []
    for i, (m, weight) in enumerate(zip(members, weights, strict=True)):
        if cross_section:
            w = Window.partitionBy(date, "fold", "is_train")
            z = (F.col("pred") - F.avg("pred").over(w)) / (F.stddev_samp("pred").over(w) + 1e-12)
            part = m.withColumn("_z", z)
        else:
            train = m.filter("is_train").groupBy("fold").agg(F.avg("pred").alias("_mu"), F.stddev_samp("pred").alias("_sd"))
            part = m.join(F.broadcast(train), "fold", "left").withColumn("_z", (F.col("pred") - F.col("_mu")) / (F.col("_sd") + 1e-12))
        parts.append(part.select(*keys, "fold", "is_train", (F.col("_z") * weight).alias("_z"), F.lit(i).alias("_i")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    whole = F.when(F.count("*") == len(members), F.sum("_z")).otherwise(F.raise_error(F.lit("ensemble members do not cover the same rows")).cast("double"))
    return stacked.groupBy(*keys, "fold", "is_train").agg(whole.alias("pred"))
