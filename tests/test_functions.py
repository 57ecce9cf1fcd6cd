import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cross_section as cs
from tidemark.functions import time_series as ts


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(0, 1, "a", 3.0), (1, 1, "a", 1.0), (2, 1, "b", None), (3, 1, "b", 2.0), (4, 2, "a", 5.0), (5, 2, "b", 5.0), (6, 2, "b", 7.0)]
    return spark.createDataFrame(rows, "i int, t0 long, g string, x double")


def values(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_ranks(tiny):
    assert values(tiny.withColumn("p", cs.percentile_rank("x")), "p") == [1.0, 0.0, None, 0.5, 0.25, 0.25, 1.0]
    assert values(tiny.withColumn("p", cs.rank_of_rows("x")), "p")[4:] == [0.25, 0.25, 1.0]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(0, 1, float("nan")), (1, 1, 2.0), (2, 1, 1.0)], "i int, t0 int, x double")
    assert values(df.withColumn("p", cs.percentile_rank("x")), "p") == [None, 1.0, 0.0]


def test_zscore_and_demean(tiny):
    z = values(tiny.withColumn("z", cs.zscore("x")), "z")[4:]
    assert np.mean(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)
    assert values(tiny.withColumn("d", cs.demean("x", ["t0", "g"])), "d")[:2] == [1.0, -1.0]


def test_later_rows_change_nothing(tiny, spark):
    more = tiny.union(spark.createDataFrame([(7, 3, "a", 100.0)], tiny.schema))
    for c in (cs.percentile_rank("x"), cs.zscore("x"), cs.demean("x")):
        assert values(more.withColumn("c", c), "c")[:7] == values(tiny.withColumn("c", c), "c")


def test_rolling_lag_forward(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "i int, x double")
    z = values(df.withColumn("z", ts.rolling_zscore("x", 5, "i", min_samples=3)), "z")
    assert z[:2] == [None, None] and z[4] == pytest.approx(2 / np.std(range(5), ddof=1))
    p = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 4.0), (3, "b", 10.0), (4, "b", 5.0)], "i int, g string, p double")
    assert values(p.withColumn("l", ts.lag("p", 1, "i", "g")), "l") == [None, 1, 2, None, 10]
    f = values(p.withColumn("f", ts.forward_return("p", 1, "i", "g")), "f")
    assert f[2] is None and f[4] is None and [f[0], f[1], f[3]] == pytest.approx([math.log(2), math.log(2), math.log(0.5)])


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 5.0), (2, 2.0, 6.0)], "d int, x double, y double")
    assert {r["d"]: r["ic"] for r in cs.spearman(df, "x", "y", "d").collect()} == {1: None, 2: 1.0}


@pytest.mark.parametrize("exposures", [["beta"], ["beta", "size"], []])
def test_residualize(spark, exposures):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 4), "abc"[i % 3] if i % 13 else None, float(rng.normal()), float(rng.normal()) if i % 7 else None, float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, t0 int, sector string, y double, beta double, size double")
    got = {r["i"]: r["residual"] for r in cs.residualize(df, "y", "t0", ["sector"], exposures).collect()}
    assert len(got) == 120
    for day in range(4):
        own = [r for r in rows if r[1] == day and ("beta" not in exposures or r[4] is not None)]
        levels = sorted({r[2] or "<null>" for r in own})
        x = np.array([[1.0, *[(r[2] or "<null>") == v for v in levels[1:]], *[r[{"beta": 4, "size": 5}[e]] for e in exposures]] for r in own], float)
        y = np.array([r[3] for r in own])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert [got[r[0]] for r in own] == pytest.approx(list(want), abs=1e-9)
    assert all(got[r[0]] is None for r in rows if "beta" in exposures and r[4] is None)


def test_rank_panel_keeps_columns(tiny):
    assert cs.rank_panel(tiny, ["x"], ["t0", "g"]).columns == ["t0", "g", "x"]
    assert tiny.filter("false").withColumn("p", cs.percentile_rank("x")).agg(F.count("*")).first()[0] == 0
