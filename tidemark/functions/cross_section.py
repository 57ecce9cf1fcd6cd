"""Within-date column builders. Each returns a Column over one window per date, so several share one shuffle and sort.

Nulls take no rank and stay null; NaN counts as null. A date's names meet in one task: a cross-section is the size of a
universe, not of the history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = str | Sequence[str]


def _by(by: By) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def finite(col: str) -> Column:
    """The column as a double, NaN as null."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def average_rank(col: str, by: By) -> Column:
    """Rank from 1, ties sharing the mean of their places; null for null."""
    order = Window.partitionBy(*_by(by)).orderBy(finite(col).asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(finite(col).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def percentile_rank(col: str, by: By = "t0") -> Column:
    """0 for the least to 1 for the greatest of the non-null values."""
    n = F.count(finite(col)).over(Window.partitionBy(*_by(by)))
    return (average_rank(col, by) - 1) / F.greatest(n - 1, F.lit(1))


def rank_of_rows(col: str, by: By = "t0") -> Column:
    """Like percentile_rank, over the number of rows whether null or not."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*_by(by)))
    return (average_rank(col, by) - 1) / F.greatest(n - 1, F.lit(1))


def zscore(col: str, by: By = "t0", eps: float = 0.0) -> Column:
    w = Window.partitionBy(*_by(by))
    return F.try_divide(finite(col) - F.avg(finite(col)).over(w), F.stddev_samp(finite(col)).over(w) + F.lit(eps))


def demean(col: str, by: By = "t0") -> Column:
    return finite(col) - F.avg(finite(col)).over(Window.partitionBy(*_by(by)))


def rank_panel(frame: DataFrame, features: Sequence[str], keep: Sequence[str], by: By = "t0") -> DataFrame:
    return frame.select(*keep, *[percentile_rank(f, by).alias(f) for f in features])


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(frame: DataFrame, x: str, y: str, by: By = (), name: str = "ic") -> DataFrame:
    """Rank correlation of the rows where both are known, for each group: by, name, n."""
    keys = _by(by)
    both = frame.filter(finite(x).isNotNull() & finite(y).isNotNull())
    ranks = both.select(*keys, average_rank(x, keys).alias("_x"), average_rank(y, keys).alias("_y"))
    return ranks.groupBy(*keys).agg(pearson("_x", "_y").alias(name), F.count("*").alias("n"))


def residualize(frame: DataFrame, y: str, date: str = "t0", groups: Sequence[str] = (), exposures: Sequence[str] = (), name: str = "residual", keys: Sequence[str] = ()) -> DataFrame:
    """Adds y less its per-date least-squares fit on an intercept, group dummies and exposures.

    With at most one group column this is arithmetic on windows of the date: everything is demeaned within date and group,
    which is what the dummies do, each exposure is made orthogonal to those before it, and y loses its part along each.
    An exposure that the ones before explain adds nothing. With several group columns each date is solved by itself, in a
    worker that holds the date's rows: with keys (of a row within its date) only those, y, groups and exposures, without
    them all columns. Rows with an unknown y or exposure get null and take no part; a null group is a level of its own.
    """
    known = finite(y).isNotNull()
    for e in exposures:
        known = known & finite(e).isNotNull()
    if len(groups) <= 1:
        part = [F.col(date), *[F.coalesce(F.col(g).cast("string"), F.lit("<null>")) for g in groups]]
        cell, day = Window.partitionBy(*part), Window.partitionBy(date)
        inside = lambda c: F.when(known, finite(c) - F.avg(F.when(known, finite(c))).over(cell))
        over = lambda a, b: F.sum(F.col(a) * F.col(b)).over(day)
        out = frame.withColumns({"_y": inside(y)} | {f"_x{i}": inside(e) for i, e in enumerate(exposures)})
        for i in range(len(exposures)):
            size = over(f"_x{i}", f"_x{i}")
            for j in range(i):
                out = out.withColumn(f"_x{i}", F.col(f"_x{i}") - F.coalesce(F.try_divide(over(f"_x{i}", f"_x{j}"), over(f"_x{j}", f"_x{j}")), F.lit(0.0)) * F.col(f"_x{j}"))
                if not j:
                    out = out.withColumn(f"_s{i}", size)
            if i:  # what is left of an exposure that others explain is rounding
                out = out.withColumn(f"_x{i}", F.when(over(f"_x{i}", f"_x{i}") > 1e-18 * F.col(f"_s{i}"), F.col(f"_x{i}")).otherwise(F.col(f"_x{i}") * 0))
            out = out.withColumn("_y", F.col("_y") - F.coalesce(F.try_divide(over(f"_x{i}", "_y"), over(f"_x{i}", f"_x{i}")), F.lit(0.0)) * F.col(f"_x{i}"))
        made = [f"_x{i}" for i in range(len(exposures))] + [f"_s{i}" for i in range(1, len(exposures))]
        return out.withColumn(name, F.col("_y")).drop("_y", *made)

    def solve(pdf):
        ok = pdf[[y, *exposures]].notna().all(axis=1)
        columns = [np.ones(ok.sum())]
        for g in groups:
            levels = pdf.loc[ok, g].astype("string").fillna("<null>")
            columns += [(levels == v).to_numpy(float) for v in sorted(levels.unique())[1:]]
        columns += [pdf.loc[ok, e].to_numpy(float) for e in exposures]
        pdf[name] = np.nan
        if ok.any():
            a, b = np.column_stack(columns), pdf.loc[ok, y].to_numpy(float)
            pdf.loc[ok, name] = b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
        return pdf[list(sent.columns) + [name]]

    sent = frame.select(date, *keys, *dict.fromkeys([y, *groups, *exposures])) if keys else frame
    schema = ", ".join(f"`{n}` {t}" for n, t in sent.dtypes) + f", `{name}` double"
    solved = sent.groupBy(date).applyInPandas(solve, schema).withColumn(name, F.nanvl(name, F.lit(None).cast("double")))
    return frame.join(solved.select(date, *keys, name), [date, *keys], "left") if keys else solved
