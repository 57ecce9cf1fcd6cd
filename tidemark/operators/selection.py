"""Feature selection inside a fold: clusters of correlated features, one member each by its yearly rank correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cross_section import finite, spearman


def scores(rows: DataFrame, features: Sequence[str], target: str = "y_rank", date: str = "t0", year: str = "y_year", by: Sequence[str] = ()) -> DataFrame:
    """by, feature, ic, ir, cons, n_years, for all features in one pass: unpivoted, ranked within date, averaged by year."""
    long = rows.select(*by, date, year, finite(target).alias("_t"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("_x")) for f in features])).alias("_f"))
    long = long.select(*by, date, year, "_t", "_f.*")
    years = spearman(long, "_x", "_t", [*by, "feature", date, year]).filter("ic is not null").groupBy(*by, "feature", year).agg(F.avg("ic").alias("ic"))
    one = years.groupBy(*by, "feature").agg(F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_sd"), F.count("*").alias("n_years"), F.collect_list("ic").alias("_all"))
    same = F.size(F.filter("_all", lambda x: F.signum(x) == F.signum(F.col("_m")))) / F.col("n_years")
    ir = F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd")).otherwise(F.abs("_m"))
    return one.select(*by, "feature", F.col("_m").alias("ic"), ir.alias("ir"), F.when(F.col("_m") != 0, same).otherwise(0.0).alias("cons"), "n_years")


def average_linkage(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Clusters merged by mean distance until none is within cut; members ascending, clusters by their least member."""
    groups = [[i] for i in range(len(distance))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        a, b = len(groups[i]), len(groups[j])
        row = (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def fold_correlations(rows: DataFrame, features: Sequence[str], fill: float = 0.5) -> dict[int, np.ndarray]:
    """fold -> the correlation matrix over its rows, for all folds in one aggregate."""
    x = [F.coalesce(finite(f), F.lit(fill)) for f in features]
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    out = {}
    for r in rows.groupBy("fold").agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect():
        m = out[r["fold"]] = np.eye(len(x))
        for i, j in pairs:
            scale = r[f"s{i}"] * r[f"s{j}"]
            m[i, j] = m[j, i] = r[f"c{i}_{j}"] / scale if scale > 0 else 0.0
    return out


def correlations(rows: DataFrame, features: Sequence[str], sample: int = 300_000, seed: int = 0, keys: Sequence[str] = ("root", "t0"), fill: float = 0.5) -> np.ndarray:
    """The correlation matrix over the rows, or over `sample` of them taken by least hash of their keys and seed."""
    if rows.limit(sample + 1).count() > sample:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(sample)
    return fold_correlations(rows.withColumn("fold", F.lit(0)), features, fill).get(0, np.eye(len(features)))


CHOICE = "cluster int, feature string, ic double, ir double, cons double, chosen boolean"


def _choose(features: Sequence[str], matrix: np.ndarray, made: dict, previous: Sequence[str], cut: float, min_cluster: int, tie_tol: float, singleton_ir: float, singleton_cons: float) -> list[tuple]:
    """Rows of CHOICE from correlations and scores. Small clusters are -1: each member stands for itself."""
    none = {"ic": 0.0, "ir": 0.0, "cons": 0.0, "n_years": 0}
    out = []
    for k, members in enumerate(average_linkage(1 - np.abs(matrix), 1 - cut), 1):
        got = {features[i]: made.get(features[i], none) for i in members}
        key = {f: abs(s["ic"]) * s["cons"] for f, s in got.items()}
        if len(members) >= min_cluster:
            best = max(got, key=lambda f: key[f])
            held = next((f for f in got if f in previous), None)
            if held is not None and key[held] >= (1 - tie_tol) * key[best]:
                best = held
            out += [(k, f, s["ic"], s["ir"], s["cons"], f == best) for f, s in got.items()]
        else:
            out += [(-1, f, s["ic"], s["ir"], s["cons"], abs(s["ir"]) >= singleton_ir and s["cons"] >= singleton_cons and s["n_years"] >= 2) for f, s in got.items()]
    return out


def select(rows: DataFrame, features: Sequence[str], previous: Sequence[str] = (), target: str = "y_rank", cut: float = 0.6, min_cluster: int = 3, tie_tol: float = 0.1, singleton_ir: float = 2.0, singleton_cons: float = 0.75, sample: int = 300_000, fill: float = 0.5) -> DataFrame:
    """cluster, feature, ic, ir, cons, chosen of one fold's training rows."""
    made = {r["feature"]: r for r in scores(rows, features, target).collect()}
    out = _choose(features, correlations(rows, features, sample, fill=fill), made, previous, cut, min_cluster, tie_tol, singleton_ir, singleton_cons)
    return rows.sparkSession.createDataFrame(out, CHOICE)


def select_by_fold(rows: DataFrame, features: Sequence[str], target: str = "y_rank", date: str = "t0", year: str = "y_year", cut: float = 0.6, min_cluster: int = 3, tie_tol: float = 0.1, singleton_ir: float = 2.0, singleton_cons: float = 0.75, fill: float = 0.5, keep_previous: bool = True) -> DataFrame:
    """fold and the same for every fold of training rows: two jobs for all folds, over all their rows.

    With keep_previous a fold's pick of the fold before is kept at near ties.
    """
    made: dict[int, dict] = {}
    for r in scores(rows, features, target, date, year, by=["fold"]).collect():
        made.setdefault(r["fold"], {})[r["feature"]] = r
    out, previous = [], ()
    for fold, matrix in sorted(fold_correlations(rows, features, fill).items()):
        picked = _choose(features, matrix, made.get(fold, {}), previous if keep_previous else (), cut, min_cluster, tie_tol, singleton_ir, singleton_cons)
        out += [(fold, *p) for p in picked]
        previous = tuple(p[1] for p in picked if p[-1])
    return rows.sparkSession.createDataFrame(out, "fold int, " + CHOICE)
