"""Walk-forward folds: test years, embargoed training windows, and the panel dealt to them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True, kw_only=True)
class WalkForward:
    """mode: expanding, rolling, or expanding_then_rolling (expanding while at most roll_years are there).

    embargo counts distinct index dates between the last training exit and the first test date.
    """

    start: dt.date
    first_test_year: int
    last_test_year: int | None = None
    end: dt.date | None = None
    mode: str = "expanding_then_rolling"
    roll_years: int = 4
    embargo: int = 21
    entry: str = "t0"
    exit: str = "exit_date"


def sample(index: DataFrame, w: WalkForward) -> DataFrame:
    kept = index.filter(F.col(w.entry) >= F.lit(w.start))
    return kept.filter(F.col(w.entry) <= F.lit(w.end)) if w.end else kept


def calendar(index: DataFrame, w: WalkForward) -> DataFrame:
    """day, pos: all entry and exit dates. Distinct before the one ordered window, which holds a row a date."""
    rows = sample(index, w)
    days = rows.select(F.col(w.entry).alias("day")).union(rows.select(F.col(w.exit).alias("day"))).filter("day is not null").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("day")).cast("int"))


def make_folds(index: DataFrame, w: WalkForward) -> DataFrame:
    """fold, mode, train_start, train_exit_cut, test_start, test_end, a row a test year that has any date."""
    days = calendar(index, w)
    last = F.lit(w.last_test_year) if w.last_test_year else None
    if last is None:
        last = F.lit(sample(index, w).agg(F.year(F.max(w.entry))).first()[0])
    years = days.groupBy(F.year("day").alias("fold")).agg(F.min("day").alias("test_start"), F.max("day").alias("test_end"), F.min("pos").alias("first"))
    years = years.filter((F.col("fold") >= w.first_test_year) & (F.col("fold") <= last))
    rolling = F.lit(w.mode == "rolling") | (F.lit(w.mode == "expanding_then_rolling") & (F.col("fold") - w.start.year > w.roll_years))
    start = F.when(rolling, F.greatest(F.make_date(F.col("fold") - w.roll_years, F.lit(1), F.lit(1)), F.lit(w.start))).otherwise(F.lit(w.start))
    cut = days.select(F.col("day").alias("train_exit_cut"), (F.col("pos") + w.embargo).alias("first"))
    folds = years.join(F.broadcast(cut), "first", "left")
    return folds.select("fold", F.when(rolling, "rolling").otherwise("expanding").alias("mode"), start.alias("train_start"), "train_exit_cut", "test_start", "test_end")


def collected(folds: DataFrame, w: WalkForward) -> DataFrame:
    """The fold table (a row a year) as local rows, after refusing folds without room for the embargo."""
    rows = sorted(folds.collect(), key=lambda r: r["fold"])
    for r in rows:
        if r["train_exit_cut"] is None:
            raise ValueError(f"fold {r['fold']}: fewer than {w.embargo} index dates before its first test date")
    return folds.sparkSession.createDataFrame(rows, folds.schema)


def dealt(panel: DataFrame, folds: DataFrame, w: WalkForward) -> DataFrame:
    """panel with fold and is_train: a row for each fold it serves in. Folds are a row a year, so they are broadcast."""
    f = F.broadcast(folds.select("fold", "train_start", "train_exit_cut", "test_start", "test_end"))
    entry, leave = F.col(w.entry), F.col(w.exit)
    train = (entry >= F.col("train_start")) & (leave <= F.col("train_exit_cut"))
    test = entry.between(F.col("test_start"), F.col("test_end"))
    rows = sample(panel, w).join(f, train | test)
    return rows.withColumn("is_train", ~F.coalesce(test, F.lit(False))).drop("train_start", "train_exit_cut", "test_start", "test_end")


def check_folds(index: DataFrame, folds: DataFrame, w: WalkForward, keys: tuple[str, ...] = ()) -> DataFrame:
    """The fold table with train_rows, test_rows and gap_td; raises where a fold breaks a rule.

    One aggregate over the panel and its folds; the result is a row a year.
    """
    entry, leave = F.col(w.entry), F.col(w.exit)
    train = (entry >= F.col("train_start")) & (leave <= F.col("train_exit_cut"))
    test = entry.between(F.col("test_start"), F.col("test_end"))
    both = sample(index, w).join(F.broadcast(folds), train | test).groupBy("fold", "mode", "train_start", "train_exit_cut", "test_start", "test_end").agg(
        F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"), F.max(F.when(train, leave)).alias("_exit"), F.min(F.when(test, entry)).alias("_first"),
        F.max(F.when(train, entry)).alias("_last"), F.count_if(train & test).alias("_both"), F.count_if(test & (F.year(entry) != F.col("fold"))).alias("_outside"),
    )
    days = calendar(index, w)
    out = both.join(F.broadcast(days.select(F.col("day").alias("_exit"), F.col("pos").alias("_p"))), "_exit", "left")
    out = out.join(F.broadcast(days.select(F.col("day").alias("_first"), F.col("pos").alias("_q"))), "_first", "left").withColumn("gap_td", F.col("_q") - F.col("_p"))
    rows = sorted(out.collect(), key=lambda r: r["fold"])
    for r in rows:
        if not r["train_rows"] or not r["test_rows"]:
            raise AssertionError(f"fold {r['fold']}: {r['train_rows']} training and {r['test_rows']} test rows")
        if r["gap_td"] < w.embargo:
            raise AssertionError(f"fold {r['fold']}: embargo {r['gap_td']} < {w.embargo} index dates")
        if r["_last"] >= r["_first"] or r["_both"]:
            raise AssertionError(f"fold {r['fold']}: a training entry falls inside the test period")
        if r["_outside"]:
            raise AssertionError(f"fold {r['fold']}: test rows outside the test year")
    if keys:
        d = dealt(index, folds, w)
        twice = d.groupBy("fold", *keys).agg(F.countDistinct("is_train").alias("sides")).filter("sides > 1").limit(1).collect()
        if twice:
            raise AssertionError(f"fold {twice[0]['fold']}: training and test rows overlap on {keys}")
    names = ["fold", "mode", "train_start", "train_exit_cut", "test_start", "test_end", "train_rows", "test_rows", "gap_td"]
    return out.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], out.select(*names).schema)
