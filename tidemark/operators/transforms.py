"""Input transforms fitted on each fold's training rows and applied to all its rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cross_section import finite, pearson
from .models import gram


def _train(rows: DataFrame, target: str | None) -> DataFrame:
    train = rows.filter("is_train")
    return train.filter(finite(target).isNotNull()) if target else train


def winsorize(rows: DataFrame, features: Sequence[str], q: float = 0.01, target: str | None = None) -> DataFrame:
    """Clips each feature at its training quantiles q and 1 - q."""
    if not 0 <= q < 0.5:
        raise ValueError(f"q must be in [0, 0.5), got {q}")
    ends = _train(rows, target).groupBy("fold").agg(*[F.percentile(f, F.array(F.lit(q), F.lit(1 - q))).alias(f"_q{i}") for i, f in enumerate(features)])
    out = rows.join(F.broadcast(ends), "fold")
    clip = lambda i, f: F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.get(f"_q{i}", F.lit(0))), F.get(f"_q{i}", F.lit(1))))
    return out.withColumns({f: clip(i, f) for i, f in enumerate(features)}).drop(*[f"_q{i}" for i in range(len(features))])


def interactions(rows: DataFrame, features: Sequence[str], target: str = "y_z", top: int = 4) -> DataFrame:
    """Adds products of centred pairs among the `top` inputs by training correlation; a fold's other pairs are null.

    Columns are named a×b. Ties go to the earlier input.
    """
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"_m{i}"), F.abs(F.coalesce(pearson(F.col(f), finite(target)), F.lit(0.0))).alias(f"_c{i}")]
    fits = _train(rows, target).groupBy("fold").agg(*aggs)
    k = len(features)
    for i in range(k):
        above = sum(((F.col(f"_c{j}") >= F.col(f"_c{i}")) if j < i else (F.col(f"_c{j}") > F.col(f"_c{i}"))).cast("int") for j in range(k) if j != i)
        fits = fits.withColumn(f"_in{i}", (above if k > 1 else F.lit(0)) < top)
    out = rows.join(F.broadcast(fits), "fold")
    new = {f"{features[i]}×{features[j]}": F.when(F.col(f"_in{i}") & F.col(f"_in{j}"), (F.col(features[i]) - F.col(f"_m{i}")) * (F.col(features[j]) - F.col(f"_m{j}"))) for i in range(k) for j in range(i + 1, k)}
    return out.withColumns(new).drop(*[f"{p}{i}" for p in ("_m", "_c", "_in") for i in range(k)])


def pca(rows: DataFrame, features: Sequence[str], target: str = "y_z", k: int = 5, fill: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Adds pc1 .. pck of the standardised training inputs; also the loadings (fold, component, input, loading).

    The components are the eigenvectors of the fold's correlation matrix, solved on the driver from one aggregate. The
    sign makes the largest loading positive, the first of equals.
    """
    k = min(k, len(features))
    weights, loadings = [], []
    for fold, (n, mu, s, _, _) in sorted(gram(rows, features, target, fill).items()):
        sd = np.sqrt(np.diag(s) / n) + 1e-9
        values, vectors = np.linalg.eigh(s / np.outer(sd, sd))
        v = vectors[:, np.argsort(-values, kind="stable")[:k]]
        size = np.abs(v)
        v = v * np.sign([v[np.flatnonzero(size[:, c] >= size[:, c].max() - 1e-9)[0], c] for c in range(k)])
        loadings += [(int(fold), c + 1, f, float(v[i, c])) for c in range(k) for i, f in enumerate(features)]
        weights.append((int(fold), *[float(x) for c in range(k) for x in (*(v[:, c] / sd), -(v[:, c] / sd) @ mu)]))
    names = [f"_w{c}_{i}" for c in range(k) for i in range(len(features) + 1)]
    spark = rows.sparkSession
    out = rows.join(F.broadcast(spark.createDataFrame(weights, "fold int, " + ", ".join(f"{n} double" for n in names))), "fold")
    score = lambda c: sum((F.col(f"_w{c}_{i}") * F.coalesce(F.col(f), F.lit(fill)) for i, f in enumerate(features)), F.col(f"_w{c}_{len(features)}"))
    out = out.withColumns({f"pc{c + 1}": score(c) for c in range(k)}).drop(*names)
    return out, spark.createDataFrame(loadings, "fold int, component int, input string, loading double")
