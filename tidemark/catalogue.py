"""The registered queries over the driver's tables; oracles.py holds the same in SQL."""

from __future__ import annotations

import datetime as dt
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cross_section as cs
from .functions import time_series as ts
from .operators import books, folds, judge, models, selection, transforms
from .sources import panels
from .sources.scratch import written

CS_FOLDS = folds.WalkForward(start=dt.date(1995, 1, 1), first_test_year=1998, embargo=1)
TS_FOLDS = folds.WalkForward(start=dt.date(1995, 1, 1), first_test_year=1999, embargo=5, mode="expanding", entry="date")
KEYS = ["root", "t0"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros: sums in another order differ in their last bits."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """The ranked panel dealt to folds. It is written once, narrow: a fit reads it three times and more."""
    panel = written(panels.ranked_panel(spark, d))
    return folds.dealt(panel, folds.collected(folds.make_folds(panel, CS_FOLDS), CS_FOLDS), CS_FOLDS)


def _preds(spark: SparkSession, d: str) -> DataFrame:
    """A fixed score dealt to folds."""
    return _dealt(spark, d).withColumn("pred", F.round(F.col("r1") - F.col("r2") / 2 + F.col("r3") / 4, 9))


def _ts_dealt(spark: SparkSession, d: str) -> DataFrame:
    panel = written(panels.ts_panel(spark, d))
    return folds.dealt(panel, folds.collected(folds.make_folds(panel, TS_FOLDS), TS_FOLDS), TS_FOLDS)


def _ts_preds(spark: SparkSession, d: str) -> DataFrame:
    return _ts_dealt(spark, d).filter("x1 is not null").withColumn("pred", F.col("x1"))


def percentile_rank(spark, d):
    holes = panels.cs_panel(spark, d).withColumn("x", F.when(F.pmod("root", F.lit(7)) != 0, F.col("f3")))
    return rounded(holes.select(*KEYS, cs.percentile_rank("x").alias("pct")))


def rank_of_rows(spark, d):
    holes = panels.cs_panel(spark, d).withColumn("x", F.when(F.pmod("root", F.lit(7)) != 0, F.col("f3")))
    return rounded(holes.select(*KEYS, cs.rank_of_rows("x").alias("pct")))


def zscore_within_date(spark, d):
    return rounded(panels.cs_panel(spark, d).select(*KEYS, cs.zscore("f1").alias("z1"), cs.zscore("f2").alias("z2")))


def demean_sector(spark, d):
    return rounded(panels.cs_panel(spark, d).select(*KEYS, cs.demean("y", ["t0", "sector"]).alias("y_in_sector"), cs.demean("f3").alias("f3_in_date")))


def rank_panel(spark, d):
    return rounded(cs.rank_panel(panels.cs_panel(spark, d), ["f1", "f2", "f3"], KEYS))


def residualize_sector_beta(spark, d):
    panel = panels.cs_panel(spark, d).withColumn("beta", F.when(F.pmod("root", F.lit(11)) != 0, F.col("f3")))
    return rounded(cs.residualize(panel, "y", "t0", ["sector"], ["beta"]).select(*KEYS, "residual"))


def residualize_general(spark, d):
    panel = panels.ranked_panel(spark, d).select(*KEYS, "sector", "y", "r1", "r2")
    return rounded(cs.residualize(panel, "y", "t0", ["sector"], ["r1", "r2"]).select(*KEYS, "residual"))


def rolling_zscore(spark, d):
    return rounded(panels.ts_panel(spark, d).select("date", ts.rolling_zscore("rev", 21, "date").alias("z21"), ts.rolling_zscore("r", 63, "date", min_samples=10).alias("z63")))


def rolling_mean(spark, d):
    return rounded(panels.cs_panel(spark, d).select(*KEYS, ts.rolling_mean("f1", 3, "t0", "root").alias("mean3")))


def lag_forward_return(spark, d):
    return rounded(panels.cs_panel(spark, d).select(*KEYS, ts.lag("f1", 1, "t0", "root").alias("lag1"), ts.forward_return("f1", 2, "t0", "root").alias("ahead2")))


def momentum(spark, d):
    return rounded(panels.cs_panel(spark, d).select(*KEYS, ts.momentum("f1", 12, 1, "t0", "root").alias("momentum")))


def fold_table(spark, d):
    panel = panels.cs_panel(spark, d)
    return folds.check_folds(panel, folds.collected(folds.make_folds(panel, CS_FOLDS), CS_FOLDS), CS_FOLDS)


def _predicted(rows: DataFrame, model: models.Linear) -> DataFrame:
    return rounded(model.predict(rows).select(*KEYS, "fold", "is_train", "pred"))


def ridge_walk_forward(spark, d):
    rows = _dealt(spark, d)
    return _predicted(rows, models.ridge(rows, ["r1", "r2"], alpha=0.5))


def ridge_prior_walk_forward(spark, d):
    rows = _dealt(spark, d)
    return _predicted(rows, models.ridge(rows, ["r1", "r2"], alpha=0.5, prior={"r1": 1.0, "r2": -0.5}))


def composite_walk_forward(spark, d):
    rows = _dealt(spark, d)
    return _predicted(rows, models.composite(rows, ["r1", "r2"], least=0.001))


def rule_walk_forward(spark, d):
    return rounded(models.rule(_ts_dealt(spark, d), ["x1", "x2"], "r_next", margin=0.1))


def gbt_walk_forward(spark, d):
    preds, _ = models.boosted(_dealt(spark, d), ["r1", "r2", "r3"], trees=5, depth=2)
    return preds.select(*KEYS, "fold", "is_train", "pred")


def in_sample_ic(spark, d):
    rows = _dealt(spark, d)
    return rounded(models.in_sample_ic(models.ridge(rows, ["r1", "r2"], alpha=0.5).predict(rows).withColumn("pred", F.round("pred", 9))))


def winsorize_in_fold(spark, d):
    return rounded(transforms.winsorize(_dealt(spark, d), ["f1", "f2"], 0.1).select(*KEYS, "fold", "is_train", "f1", "f2"))


def interactions_in_fold(spark, d):
    out = transforms.interactions(_dealt(spark, d), ["r1", "r2", "r3"], top=2)
    return rounded(out.select(*KEYS, "fold", "is_train", F.col("`r1×r2`").alias("p12"), F.col("`r1×r3`").alias("p13"), F.col("`r2×r3`").alias("p23")))


def pca_in_fold(spark, d):
    out, _ = transforms.pca(_dealt(spark, d), ["r1", "r2"], k=2)
    return rounded(out.select(*KEYS, "fold", "is_train", "pc1", "pc2"), 5)


def selection_scores(spark, d):
    return rounded(selection.scores(_dealt(spark, d).filter("is_train"), ["r1", "r2", "r3"], by=["fold"]))


def _clustered(spark, d) -> tuple[DataFrame, list[str]]:
    train = _dealt(spark, d).filter("is_train").withColumns({"r1b": F.col("r1") + 0.1 * F.col("r2"), "r1c": F.col("r1") - 0.1 * F.col("r3")})
    return train, ["r1", "r1b", "r1c", "r2", "r3"]


def cluster_selection(spark, d):
    """Each fold's selection, the one before it settling near ties."""
    return selection.select_by_fold(*_clustered(spark, d))


def fold_correlations(spark, d):
    rows, features = _clustered(spark, d)
    found = selection.fold_correlations(rows, features)
    pairs = [(f, features[i], features[j], float(m[i, j])) for f, m in sorted(found.items()) for i in range(len(features)) for j in range(i + 1, len(features))]
    return rounded(spark.createDataFrame(pairs, "fold int, first string, second string, corr double"))


def zscore_ensemble(spark, d):
    rows = _dealt(spark, d)
    members = [rows.select(*KEYS, "fold", "is_train", F.col(c).alias("pred")) for c in ("r1", "r3")]
    return rounded(models.zscore_ensemble(members, [0.6, 0.4], KEYS))


def zscore_ensemble_ts(spark, d):
    rows = _ts_dealt(spark, d).filter("x1 is not null and x2 is not null")
    members = [rows.select("date", "fold", "is_train", F.col(c).alias("pred")) for c in ("x1", "x2")]
    return rounded(models.zscore_ensemble(members, [0.6, 0.4], ["date"], "date", cross_section=False))


def weight_stability(spark, d):
    return rounded(models.stability(models.ridge(_dealt(spark, d), ["r1", "r2"], alpha=0.5).table(spark)))


def _book(spark, d) -> DataFrame:
    frame = panels.cs_panel(spark, d).withColumn("eligible", F.col("f3") >= 24)
    return books.quantile_book(_preds(spark, d).select(*KEYS, "fold", "is_train", "pred"), frame, q=0.2)


def quantile_book(spark, d):
    return rounded(_book(spark, d).select(*KEYS, "pred", "pct", "n_eligible", "side", F.col("decile").cast("int").alias("decile")))


def trailing_pool_book(spark, d):
    events = panels.order_events(spark, d)
    out = books.quantile_book(events.select("key", "t0", "pred"), events.select("key", "t0").withColumn("eligible", F.lit(True)), ["key", "t0"], 0.1, pool_days=91, min_pool=20)
    return rounded(out.select("key", "t0", "pct", "n_eligible", "side"))


def fold_standardised(spark, d):
    return rounded(books.fold_standardised(_preds(spark, d)).select(*KEYS, "fold", "pred"))


def _days(spark, d) -> DataFrame:
    return books.daily_book(_book(spark, d), books.one_period_paths(panels.cs_panel(spark, d)))


def daily_book(spark, d):
    return rounded(_days(spark, d))


def daily_book_from_first_live(spark, d):
    return rounded(books.from_first_live(_days(spark, d), 2).select("date", "ls", "n_long", "n_short"))


_SPAN = (dt.date(1999, 1, 1), dt.date(2001, 6, 30))


def _signal(spark, d, **how) -> DataFrame:
    return books.signal_book(_ts_preds(spark, d).select("date", "fold", "is_train", "pred"), panels.ts_panel(spark, d), cost=0.0005, **how)


def signal_book(spark, d):
    return rounded(_signal(spark, d).select("date", "fold", "position", "turnover", "pnl"))


def signal_book_short_only(spark, d):
    return rounded(_signal(spark, d, kind="sign", short_only=True).select("date", "fold", "position", "turnover", "pnl"))


def constant_book(spark, d):
    return rounded(books.constant_book(panels.ts_panel(spark, d), -1.0, *_SPAN, cost=0.0005).select("date", "position", "turnover", "pnl"))


def rule_book(spark, d):
    return rounded(books.rule_book(panels.ts_panel(spark, d), "x2", *_SPAN, cap=1.5, cost=0.0005, long_only=True).select("date", "position", "turnover", "pnl"))


def active_series(spark, d):
    bench = books.constant_book(panels.ts_panel(spark, d), -1.0, *_SPAN, cost=0.0005)
    return rounded(books.active(_signal(spark, d), bench))


def _path_preds(spark, d) -> DataFrame:
    return _ts_preds(spark, d).select(F.col("date").alias("t0"), "pred", "fold", "is_train")


def _sizes(spark, d, rule):
    return rounded(books.sizes(_path_preds(spark, d), rule))


def _path_days(spark, d) -> DataFrame:
    return books.path_pnl(panels.trades(spark, d), _path_preds(spark, d).filter(~F.col("is_train")), weight="pred", scale=7.3123)


def path_daily_pnl(spark, d):
    return rounded(_path_days(spark, d))


def path_on_calendar(spark, d):
    ends = panels.trades(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return rounded(books.on_calendar(_path_days(spark, d), ends.select(F.explode(F.sequence("a", "b")).alias("date")), *_SPAN))


def path_final_pnl(spark, d):
    return rounded(books.final_pnl(panels.trades(spark, d), scale=7.3123))


def sizing_diagnostics(spark, d):
    y = books.final_pnl(panels.trades(spark, d), scale=7.3123)
    weights = books.out_of_sample(_path_preds(spark, d)).select("t0", F.col("pred").alias("w"))
    return rounded(judge.sizing(weights, y).drop("mean_w_flagged"))


def book_stats(spark, d):
    stats = judge.book_stats(_days(spark, d), periods=12, block=6)
    rows = [(side, stats[side]["n"], *[float(stats[side][c]) for c in ("sharpe", "total", "max_drawdown")], stats["avg_live_long"], stats["avg_live_short"]) for side in ("long", "short", "ls")]
    return rounded(spark.createDataFrame(rows, "side string, n bigint, sharpe double, total double, max_drawdown double, avg_live_long double, avg_live_short double"))


def decile_spread(spark, d):
    return rounded(books.decile_spread(books.out_of_sample(_preds(spark, d)), q=0.1))


def ic_by_year(spark, d):
    return rounded(judge.ic_by_year(books.out_of_sample(_preds(spark, d))))


def ts_ic_by_year(spark, d):
    return rounded(judge.ts_ic_by_year(books.out_of_sample(_ts_preds(spark, d)), "pred", "r_next"))


def per_date_ic(spark, d):
    return rounded(judge.per_date_ic(books.out_of_sample(_preds(spark, d)), "pred", "y"))


def fama_macbeth(spark, d):
    return rounded(judge.fama_macbeth(books.out_of_sample(_preds(spark, d))))


def power_ic_volatility(spark, d):
    return rounded(judge.ic_volatility(panels.cs_panel(spark, d), ["f1", "f2", "f3"]))


def series_stats(spark, d):
    return rounded(judge.series_stats(panels.region_series(spark, d), ["candidate"], periods=12))


def sharpe_by_year(spark, d):
    return rounded(judge.sharpe_by_period(panels.region_series(spark, d), ["candidate"], periods=12, least=12))


def sharpe_by_half_year(spark, d):
    return rounded(judge.sharpe_by_period(panels.region_series(spark, d), ["candidate"], periods=12, least=6, half_years=True))


def _pair(spark, d):
    """The candidates' names and series on their common dates, collected once: a row a month and candidate."""
    held: dict[str, list] = {}
    for r in judge.align(panels.region_series(spark, d)).collect():
        held.setdefault(r["candidate"], []).append((r["date"], r["pnl"]))
    columns = {n: tuple(zip(*sorted(rows), strict=True)) for n, rows in held.items()}
    return sorted(held), {n: (days, np.array(x, float)) for n, (days, x) in columns.items()}


def bootstrap_ci(spark, d):
    names, series = _pair(spark, d)
    out = [(n, *[float(v) for v in (b["sharpe"], *b["sharpe_ci"], *b["mean_ci"], b["p_mean_le_0"])]) for n in names for b in [judge.bootstrap(series[n][1], 12, 6)]]
    return spark.createDataFrame(out, "candidate string, sharpe double, sharpe_lo double, sharpe_hi double, mean_lo double, mean_hi double, p_mean_le_0 double")


def paired_bootstrap(spark, d):
    names, series = _pair(spark, d)
    out = [(n, b["d_sharpe"], *b["d_sharpe_ci"], b["p_d_le_0"], b["corr"]) for n in names[1:] for b in [judge.paired_sharpe_diff(series[names[0]][1], series[n][1], 12, 6)]]
    return spark.createDataFrame(out, "candidate string, d_sharpe double, lo double, hi double, p_d_le_0 double, corr double")


def factor_attribution_1f(spark, d):
    rows = panels.region_series(spark, d)
    market = rows.groupBy("date").agg(F.round(F.avg("pnl"), 10).alias("market"))
    return rounded(judge.attribution_one(rows.join(market, "date"), "pnl", "market", ["candidate"]))


def factor_attribution(spark, d):
    rows = judge.align(panels.region_series(spark, d))
    names = sorted(r[0] for r in rows.select("candidate").distinct().collect())
    wide = rows.groupBy("date").agg(*[F.max(F.when(F.col("candidate") == n, F.col("pnl"))).alias(c) for n, c in zip(names, ("y", "first", "second"), strict=False)])
    return rounded(judge.attribution(wide, "y", ["first", "second"]).drop("sharpe", "rest_sharpe"))


def return_moments(spark, d):
    return rounded(judge.moments(panels.region_series(spark, d), ["candidate"]))


def deflated_sharpe(spark, d):
    stats = judge.series_stats(panels.region_series(spark, d), ["candidate"], periods=12).collect()
    stats.sort(key=lambda r: r["candidate"])
    out = judge.deflated_sharpe([r["sharpe"] for r in stats], min(r["n"] for r in stats), 12)
    row = (stats[out.best]["candidate"], out.trials, out.sharpe, out.expected_by_luck, out.probability, out.probability_above_zero)
    return rounded(spark.createDataFrame([row], "best string, trials int, sharpe double, expected_by_luck double, probability double, probability_above_zero double"))


def align_series(spark, d):
    rows = panels.region_series(spark, d)
    return judge.align(rows.filter((F.col("candidate") != "ASIA") | (F.month("date") != 5)))


def walk_forward_selection(spark, d):
    return rounded(judge.walk_forward_selection(panels.region_series(spark, d), 12, costs={"ASIA": 0.01}))


def stitched_series(spark, d):
    rows = panels.region_series(spark, d)
    return rounded(judge.stitched(rows, judge.walk_forward_selection(rows, 12)))


def pbo_logits(spark, d):
    return rounded(judge.pbo_logits(panels.region_series(spark, d), 6, 12))


_SEAL = dt.date(2000, 7, 1)


def holdout_dev(spark, d):
    return judge.holdout(panels.cs_panel(spark, d), _SEAL).select(*KEYS)


def holdout_horizon(spark, d):
    rows = panels.cs_panel(spark, d).withColumn("horizon", F.add_months("t0", 2))
    return judge.holdout_counts(rows, _SEAL, "t0", "horizon")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Panel, ranks, folds, ridge, out-of-sample predictions, a book of the outer fifths, and its daily long-short."""
    rows = _dealt(spark, d)
    preds = models.ridge(rows, ["r1", "r2", "r3"], alpha=0.5).predict(rows).select(*KEYS, "fold", "is_train", "pred")
    frame = panels.cs_panel(spark, d).withColumn("eligible", F.lit(True))
    return rounded(books.daily_book(books.quantile_book(preds, frame, q=0.2), books.one_period_paths(frame)))


_NAMES = """percentile_rank rank_of_rows zscore_within_date demean_sector rank_panel residualize_sector_beta residualize_general
rolling_zscore rolling_mean lag_forward_return momentum fold_table ridge_walk_forward ridge_prior_walk_forward
composite_walk_forward rule_walk_forward gbt_walk_forward in_sample_ic winsorize_in_fold interactions_in_fold pca_in_fold
selection_scores cluster_selection fold_correlations zscore_ensemble zscore_ensemble_ts weight_stability quantile_book trailing_pool_book
fold_standardised daily_book daily_book_from_first_live signal_book signal_book_short_only constant_book rule_book
active_series path_daily_pnl path_on_calendar path_final_pnl sizing_diagnostics book_stats decile_spread ic_by_year ts_ic_by_year per_date_ic
fama_macbeth power_ic_volatility series_stats sharpe_by_year sharpe_by_half_year bootstrap_ci paired_bootstrap
factor_attribution_1f factor_attribution return_moments deflated_sharpe align_series walk_forward_selection stitched_series
pbo_logits holdout_dev holdout_horizon""".split()


def queries() -> dict:
    sizes = {f"path_sizes_{rule}": partial(_sizes, rule=rule) for rule in ("constant", "rank", "tercile", "inverse", "direct")}
    return {n: globals()[n] for n in _NAMES} | sizes
