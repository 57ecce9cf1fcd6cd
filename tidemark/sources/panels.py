"""Panels from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cross_section import percentile_rank, zscore
from ..functions.time_series import rolling_zscore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cs_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month: root, t0, exit_date, f1 revenue, f2 mean discount, f3 mean quantity, y, y_year, sector."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("t0"), "l_extendedprice", "l_discount", "l_quantity")
    months = lines.groupBy(F.col("l_suppkey").alias("root"), "t0").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("f1"), F.round(F.avg("l_discount"), 8).alias("f2"), F.round(F.avg("l_quantity"), 8).alias("f3")
    )
    w = Window.partitionBy("root").orderBy("t0")
    panel = months.withColumns({"exit_date": F.lead("t0").over(w), "y": F.round(F.ln(F.lead("f1").over(w) / F.col("f1")), 10)}).filter("exit_date is not null")
    places = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("root"), F.col("r_name").alias("sector"))
    return panel.join(places, "root").select("root", "t0", "exit_date", "f1", "f2", "f3", "y", F.year("t0").alias("y_year"), "sector")


def ranked_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cs_panel with r1, r2, r3, y_rank and y_z within date."""
    ranks = {f"r{i}": percentile_rank(f"f{i}") for i in (1, 2, 3)}
    return cs_panel(spark, sf_dir).withColumns(ranks | {"y_rank": percentile_rank("y"), "y_z": zscore("y")})


def ts_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a ship date: rev, r (change of log revenue to this date), r_next, x1, x2, exit_date, y_year.

    One series: its windows run in one task, over as many rows as there are days.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_discount")
    days = lines.groupBy("date").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("rev"))
    w = Window.orderBy("date")
    days = days.withColumns({"r": F.round(F.ln(F.col("rev") / F.lag("rev").over(w)), 10), "r_next": F.round(F.ln(F.lead("rev").over(w) / F.col("rev")), 10), "exit_date": F.lead("date").over(w), "y_year": F.year("date")})
    return days.withColumns({"x1": F.round(rolling_zscore("rev", 21, "date"), 10), "x2": F.round(rolling_zscore("r", 63, "date"), 10)})


def trades(spark: SparkSession, sf_dir: str, hold: int = 20) -> DataFrame:
    """Overlapping paths: each ship date enters a trade marked on the next `hold` ship dates; pnl sums r since entry."""
    days = ts_panel(spark, sf_dir).select("date", F.coalesce("r", F.lit(0.0)).alias("r"))
    w = Window.orderBy("date")
    days = days.withColumns({"k": F.row_number().over(w), "total": F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    steps = days.select(F.col("date").alias("t0"), F.col("k").alias("k0"), F.col("total").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(hold))).alias("step"))
    marks = steps.join(days.select("date", "k", "total"), F.col("k") == F.col("k0") + F.col("step"))
    return marks.select("t0", "date", (F.col("total") - F.col("start")).alias("pnl"), F.col("step").alias("held"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as irregular events: root (customer), key, t0, pred."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("t0"), F.col("o_totalprice").alias("pred"))


def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate (region), date (month), pnl: monthly change of log revenue of each region's suppliers."""
    panel = cs_panel(spark, sf_dir)
    months = panel.groupBy(F.col("sector").alias("candidate"), F.col("t0").alias("date")).agg(F.round(F.sum("f1"), 4).alias("rev"))
    w = Window.partitionBy("candidate").orderBy("date")
    return months.select("candidate", "date", F.round(F.ln(F.col("rev") / F.lag("rev").over(w)), 10).alias("pnl")).filter("pnl is not null")
