"""Predictions to positions to daily P&L."""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import rank_of_rows
from ..sources.scratch import written


def out_of_sample(preds: DataFrame) -> DataFrame:
    return preds.filter(~F.col("is_train")) if "is_train" in preds.columns else preds


def fold_standardised(preds: DataFrame) -> DataFrame:
    """Out-of-sample rows with pred standardised by its fold's training rows, where those vary."""
    train = preds.filter("is_train").groupBy("fold").agg(F.avg("pred").alias("_mu"), F.stddev_samp("pred").alias("_sd")).filter("_sd > 0")
    z = F.when(F.col("_sd").isNotNull(), (F.col("pred") - F.col("_mu")) / F.col("_sd")).otherwise(F.col("pred"))
    return out_of_sample(preds).join(F.broadcast(train), "fold", "left").withColumn("pred", z).drop("_mu", "_sd")


#: Predictions of a pool that a bin should hold, and bins at most.
PER_BIN, MOST_BINS = 16, 2048


def _passed(x: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are at most x, looked for in two steps of about sqrt(len(edges)) comparisons."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges) - 1) + 1
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    whole = F.size(F.filter(listed(edges[step - 1 :: step]), lambda e: e <= x)) * step
    return whole + F.size(F.filter(F.slice(listed(edges), whole + 1, F.lit(step)), lambda e: e <= x))


def trailing_pct(rows: DataFrame, date: str = "t0", pool_days: int = 91, min_pool: int = 1, pred: str = "pred") -> DataFrame:
    """rows with pct: the mid-rank of pred among those dated in [date - pool_days, date); null if too few or unknown.

    Values are cut into bins of about equal counts. A table of dates and bins, bounded by time and not by rows, tells by
    running sums how many predictions of a date's pool fall into lower bins. Only those of a row's own bin, some PER_BIN
    of its pool, are met one by one, through buckets of pool_days (two a date, an equi-join).
    """
    known = rows.filter(F.col(pred).isNotNull()).select(F.col(date).alias("_d"), F.col(pred).cast("double").alias("_x"))
    seen = written(known.groupBy("_d", "_x").agg(F.count("*").alias("_n")))
    n, days = seen.agg(F.sum("_n"), F.datediff(F.max("_d"), F.min("_d")) + 1).first()
    bins = int(min(MOST_BINS, max(1, (n or 0) * min(1.0, pool_days / (days or 1)) // PER_BIN)))
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cuts = seen.agg(F.percentile_approx("_x", shares, F.lit(20 * bins))).first()[0] if bins > 1 and n else []
    edges = sorted(set(cuts))
    binned = written(seen.withColumns({"_b": _passed(F.col("_x"), edges).cast("int"), "_t": F.unix_date("_d")}))
    # how many of a date's pool fall into each bin, then into those below it
    grid = seen.select("_d").distinct().select("_d", F.unix_date("_d").alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("_b"))
    table = grid.join(binned.groupBy("_d", "_b").agg(F.sum("_n").alias("_n")), ["_d", "_b"], "left")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("_t").rangeBetween(-pool_days, -1)), F.lit(0))
    whole, lower = Window.partitionBy("_d"), Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_in", inside).select("_d", "_b", F.coalesce(F.sum("_in").over(lower), F.lit(0)).alias("_lower"), F.sum("_in").over(whole).alias("_pool"))
    bucket = F.floor(F.col("_t") / pool_days)
    asked = binned.select("_d", "_x", "_b", "_t", F.explode(F.array(bucket, bucket - 1)).alias("_k"))
    held = binned.select("_b", bucket.alias("_k"), F.col("_t").alias("_u"), F.col("_x").alias("_y"), F.col("_n").alias("_m"))
    near = asked.join(held, ["_b", "_k"]).filter((F.col("_u") < F.col("_t")) & (F.col("_u") >= F.col("_t") - pool_days) & (F.col("_y") <= F.col("_x")))
    own = near.groupBy("_d", "_x").agg(F.sum(F.when(F.col("_y") < F.col("_x"), 2 * F.col("_m")).otherwise(F.col("_m"))).alias("_own"))
    placed = binned.join(table, ["_d", "_b"]).join(own, ["_d", "_x"], "left").filter(F.col("_pool") >= max(min_pool, 1))
    placed = placed.select("_d", "_x", ((2 * F.col("_lower") + F.coalesce("_own", F.lit(0))) / (2 * F.col("_pool"))).alias("pct"))
    return rows.join(placed, (rows[date] == placed["_d"]) & (rows[pred].cast("double") == placed["_x"]), "left").drop("_d", "_x")


def quantile_book(preds: DataFrame, frame: DataFrame, keys: Sequence[str] = ("root", "t0"), q: float = 0.1, date: str = "t0", pool_days: int = 0, min_pool: int = 0, standardise: bool = True) -> DataFrame:
    """Eligible rows of frame with an out-of-sample pred: pct, n_eligible, side (long, short or null) and decile."""
    oos = fold_standardised(preds) if pool_days > 0 and standardise and {"fold", "is_train"} <= set(preds.columns) else out_of_sample(preds)
    rows = frame.join(oos.select(*keys, "pred", *[c for c in ("fold",) if c in oos.columns]), list(keys)).filter("eligible")
    rows = trailing_pct(rows, date, pool_days, min_pool) if pool_days > 0 else rows.withColumn("pct", rank_of_rows("pred", date))
    near = 1e-12  # a percentile on the bound is in, whatever its last bit
    side = F.when(F.col("pct") >= 1 - q - near, "long").when(F.col("pct") <= q + near, "short")
    decile = F.least(F.greatest(F.floor(F.col("pct") * 10 + near), F.lit(0)), F.lit(9)).cast("tinyint")
    return rows.withColumns({"n_eligible": F.count(F.lit(1)).over(Window.partitionBy(date)), "side": side, "decile": decile})


def daily_book(positions: DataFrame, paths: DataFrame, keys: Sequence[str] = ("root", "t0"), end: dt.date | None = None) -> DataFrame:
    """Per date: long and short sums of the marks' changes (a first mark changes nothing), live counts, means, ls, ls_pp."""
    held = paths.join(positions.select(*keys, "side"), list(keys))
    step = F.coalesce(F.col("pnl") - F.lag("pnl").over(Window.partitionBy(*keys).orderBy("date")), F.lit(0.0))
    long, short = F.col("side") == "long", F.col("side") == "short"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_d"))), F.lit(0.0))
    days = held.withColumn("_d", step).groupBy("date").agg(total(long).alias("long"), total(short).alias("short"), F.count_if(long).alias("n_long"), F.count_if(short).alias("n_short"))
    days = days.withColumns({"long_pp": F.col("long") / F.greatest("n_long", F.lit(1)), "short_pp": F.col("short") / F.greatest("n_short", F.lit(1))})
    days = days.withColumns({"ls": F.col("long") - F.col("short"), "ls_pp": F.col("long_pp") - F.col("short_pp")})
    return days.filter(F.col("date") <= F.lit(end)) if end else days


def from_first_live(days: DataFrame, least: int) -> DataFrame:
    """The days from the first on which both sides hold at least so many."""
    first = days.filter((F.col("n_long") >= least) & (F.col("n_short") >= least)).agg(F.min("date").alias("_first"))
    return days.join(F.broadcast(first), F.col("date") >= F.col("_first")).drop("_first")


def one_period_paths(frame: DataFrame, keys: Sequence[str] = ("root", "t0"), y: str = "y", entry: str = "t0", leave: str = "exit_date") -> DataFrame:
    """Two marks a row: 0 at entry, y at exit."""
    marks = F.array(F.struct(F.col(entry).alias("date"), F.lit(0.0).alias("pnl")), F.struct(F.col(leave).alias("date"), F.col(y).alias("pnl")))
    return frame.select(*keys, F.explode(marks).alias("_m")).select(*keys, "_m.*")


def _traded(rows: DataFrame, position: Column, date: str, ret: str, cost: float, over: Sequence[str] = ()) -> DataFrame:
    """Position, turnover (from flat) and pnl. One series runs in one task; `over` splits many."""
    w = Window.partitionBy(*over).orderBy(date)
    rows = rows.withColumn("position", position)
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    return rows.withColumn("turnover", turn).withColumn("pnl", F.col("position") * F.col(ret) - cost * F.col("turnover"))


def _bounds(cap: float, long_only: bool, short_only: bool) -> tuple[float, float]:
    return 0.0 if long_only else -cap, 0.0 if short_only else cap


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def signal_book(preds: DataFrame, frame: DataFrame, kind: str = "scaled", cap: float = 1.0, cost: float = 0.0, long_only: bool = False, short_only: bool = False, date: str = "date", ret: str = "r_next") -> DataFrame:
    """Out-of-sample dates held at pred over its in-sample sd (or its sign), within the cap and the allowed sides."""
    sds = preds.filter("is_train").groupBy("fold").agg(F.stddev_samp("pred").alias("_sd"))
    rows = out_of_sample(preds).join(F.broadcast(sds), "fold", "left").join(frame.select(date, ret), date)
    raw = F.signum("pred") if kind == "sign" else _clip(F.try_divide(F.col("pred"), F.col("_sd")), -cap, cap)
    return _traded(rows, _clip(raw, *_bounds(cap, long_only, short_only)), date, ret, cost).drop("_sd")


def constant_book(frame: DataFrame, position: float, start: dt.date, end: dt.date, cost: float = 0.0, date: str = "date", ret: str = "r_next") -> DataFrame:
    rows = frame.filter(F.col(date).between(F.lit(start), F.lit(end))).select(date, ret)
    return _traded(rows, F.lit(float(position)), date, ret, cost)


def rule_book(frame: DataFrame, position: str, start: dt.date, end: dt.date, cap: float = 1.0, cost: float = 0.0, long_only: bool = False, short_only: bool = False, date: str = "date", ret: str = "r_next") -> DataFrame:
    """The position is a column known at the date; unknown is flat."""
    rows = frame.filter(F.col(date).between(F.lit(start), F.lit(end))).select(date, ret, F.col(position).alias("_p"))
    return _traded(rows, _clip(F.coalesce(F.col("_p").cast("double"), F.lit(0.0)), *_bounds(cap, long_only, short_only)), date, ret, cost).drop("_p")


def active(book: DataFrame, benchmark: DataFrame, date: str = "date") -> DataFrame:
    """date, pnl: the book less the benchmark on common dates."""
    return book.select(date, F.col("pnl").alias("_a")).join(benchmark.select(date, F.col("pnl").alias("_b")), date).select(date, (F.col("_a") - F.col("_b")).alias("pnl"))


def sizes(preds: DataFrame, rule: str = "rank", entry: str = "t0", cap: float = 2.0) -> DataFrame:
    """entry, pred, w for out-of-sample rows, from earlier predictions only.

    A row's history is its fold's training predictions and all earlier out-of-sample ones (direct: its fold's only). The
    rows are one series, bounded by time; a single task goes through it in order beside a sorted history, in which each
    weight is a binary search.
    """
    if rule not in ("constant", "rank", "tercile", "inverse", "direct"):
        raise ValueError(f"no such rule: {rule}")
    if rule == "constant":
        return out_of_sample(preds).select(entry, "pred", F.lit(1.0).alias("w"))

    def weight(x: float, history: list[float], up: float) -> float:
        n = len(history)
        if rule == "direct":
            return min(max(x, 0.0) / (up / n if n and up > 0 else 1.0), cap)
        if rule == "inverse":
            middle = (history[(n - 1) // 2] + history[n // 2]) / 2 if n else x
            return min(max(middle / x, 0.0), cap) if x > 0 and middle > 0 else 1.0
        share = bisect_left(history, x) / n if n else 0.5
        return 2 * share if rule == "rank" else 0.0 if share < 1 / 3 else 1.0 if share < 2 / 3 else 2.0

    def walk(series):
        earlier: list[float] = []
        out = []
        for _, part in series.sort_values(["fold", entry], kind="stable").groupby("fold", sort=True):
            trained = part["pred"][part["is_train"]].dropna().tolist()
            history = sorted(trained if rule == "direct" else trained + earlier)
            up = sum(max(h, 0.0) for h in history)
            test = part[~part["is_train"]]
            weights = []
            for x in test["pred"].tolist():
                weights.append(weight(x, history, up))
                insort(history, x)
                up += max(x, 0.0)
            earlier += test["pred"].tolist()
            out.append(test[[entry, "pred"]].assign(w=weights))
        import pandas as pd

        return pd.concat(out, ignore_index=True) if out else series[[entry, "pred"]].assign(w=0.0).iloc[:0]

    kind = preds.schema[entry].dataType.simpleString()
    rows = preds.select("fold", entry, F.col("pred").cast("double").alias("pred"), "is_train").filter("pred is not null")
    return rows.groupBy().applyInPandas(walk, f"`{entry}` {kind}, pred double, w double")


def path_pnl(trades: DataFrame, weights: DataFrame, entry: str = "t0", date: str = "date", pnl: str = "pnl", weight: str = "w", unit: str | None = None, scale: float = 1.0) -> DataFrame:
    """date, pnl: the weighted trades' changes, the first mark counting in full. Trades without a weight aren't held."""
    held = trades.join(weights.select(entry, F.col(weight).alias("_w")), entry)
    step = F.coalesce(F.col(pnl) - F.lag(pnl).over(Window.partitionBy(entry).orderBy(date)), F.col(pnl))
    return held.withColumn("_x", step * (F.col(unit) if unit else F.lit(1.0)) * F.col("_w") * scale).groupBy(F.col(date).alias("date")).agg(F.sum("_x").alias("pnl"))


def on_calendar(days: DataFrame, calendar: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """date, pnl on every calendar date in [lo, hi], 0 where flat; raises if a P&L date isn't on the calendar."""
    lost = days.join(calendar.select("date"), "date", "left_anti")
    shown = [str(r["date"]) for r in lost.select("date").orderBy("date").limit(5).collect()]
    if shown:
        raise ValueError(f"{lost.count()} P&L dates are not on the calendar: {', '.join(shown)}")
    dates = calendar.select("date").distinct().filter(F.col("date").between(F.lit(lo), F.lit(hi)))
    return dates.join(days.select("date", "pnl"), "date", "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def final_pnl(trades: DataFrame, entry: str = "t0", date: str = "date", pnl: str = "pnl", unit: str | None = None, scale: float = 1.0) -> DataFrame:
    """entry, y: each trade's last mark."""
    last = F.max_by(pnl, date) * (F.min_by(unit, date) if unit else F.lit(1.0)) * scale
    return trades.groupBy(entry).agg(last.alias("y"))


def decile_spread(rows: DataFrame, pred: str = "pred", y: str = "y", date: str = "t0", q: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mean, t of the per-date difference between the top and the bottom q."""
    ranked = rows.withColumn("_p", rank_of_rows(pred, [*by, date]))
    top, low = F.avg(F.when(F.col("_p") >= 1 - q - 1e-12, F.col(y))), F.avg(F.when(F.col("_p") <= q + 1e-12, F.col(y)))
    days = ranked.groupBy(*by, date).agg((top - low).alias("_d"))
    return days.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.try_divide(F.avg("_d") * F.sqrt(F.count("_d")), F.stddev_samp("_d")).alias("t"))
