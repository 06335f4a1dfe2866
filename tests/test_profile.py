import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaguestats.operators import profile


def _frame(seed, size=700):
    rng = np.random.default_rng(seed)
    made = pd.DataFrame({"rate": np.round(rng.random(size), 3), "count": rng.integers(0, 40, size), "skewed": rng.exponential(5, size)})
    made.loc[rng.random(size) < 0.2, "rate"] = np.nan
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_describe_equals_pandas(spark, many_ranges, seed):
    frame = _frame(seed)
    made = profile.describe_stats(spark.createDataFrame(frame), list(frame)).toPandas().set_index("Stat").loc[list(frame)]
    expected = frame.describe().T
    expected.columns = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    np.testing.assert_allclose(made.to_numpy(float), expected.to_numpy(float), rtol=1e-12)


def test_mean_and_median_equal_pandas(spark, many_ranges):
    frame = _frame(3)
    made = profile.league_profile(spark.createDataFrame(frame), list(frame)).toPandas().set_index("Stat").loc[list(frame)]
    assert list(made["mean"]) == [round(v, 3) for v in frame.mean()]
    assert list(made["median"]) == [round(v, 3) for v in frame.median()]
    whole = frame.dropna()
    made = profile.league_profile(spark.createDataFrame(frame).replace(float("nan"), None), list(frame), complete_rows=True)
    assert list(made.toPandas().set_index("Stat").loc[list(frame)]["mean"]) == [round(v, 3) for v in whole.mean()]


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("Year"), F.round(F.rand(5), 3).alias("a"), (F.col("id") % 11).alias("b")).cache()
    few = profile.league_profile(df.coalesce(1), ["a", "b"], by=["Year"])
    many = profile.league_profile(df.repartition(19), ["a", "b"], by=["Year"])
    assert sorted(few.collect()) == sorted(many.collect())
    df.unpersist()


@pytest.mark.parametrize("seed", range(4))
def test_automatic_bins_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "normal": rng.normal(size=257),
            "heavy": np.round(rng.standard_cauchy(257), 2),
            "whole": rng.integers(0, 9, 257),
            "flat": np.full(257, 4.0),
            "spiked": np.where(rng.random(257) < 0.8, 1.0, rng.random(257)),
        }
    )
    made = profile.histograms(spark.createDataFrame(frame), list(frame)).toPandas()
    for name in frame:
        got = made[made.Stat == name].sort_values("bin")
        edges = np.histogram_bin_edges(frame[name].astype(float), "auto")
        counts, _ = np.histogram(frame[name], edges)
        assert list(got["n"]) == list(counts), name
        np.testing.assert_allclose(list(got["lo"]) + [got["hi"].iloc[-1]], edges, atol=1e-9)


def test_integer_columns_may_have_narrow_bins(spark):
    frame = pd.DataFrame({"x": np.random.default_rng(0).integers(0, 5, 500)})
    made = profile.histograms(spark.createDataFrame(frame), ["x"], unit_bins=False).orderBy("bin").toPandas()
    counts, _ = np.histogram(frame.x.astype(float), "auto")
    assert list(made.n) == list(counts)


def test_fixed_bins_keep_empty_ones_and_count_everything(spark):
    values = [0.0, 0.1, 0.3, 1.0, 1.0, None]
    df = spark.createDataFrame([("y", v) for v in values] + [("z", 2.0)], "g string, x double")
    made = profile.histograms(df, ["x"], bins=5, by=["g"]).orderBy("g", "bin").toPandas()
    assert list(made[made.g == "y"].n) == [2, 1, 0, 0, 2]
    assert list(made[made.g == "z"].n) == [0, 0, 1, 0, 0] and made[made.g == "z"].lo.iloc[0] == 1.5


def test_box_plot(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "id int, x double")
    assert tuple(profile.boxplots(df, ["x"]).first()) == ("x", 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert [tuple(r) for r in profile.outliers(df, ["x"], ["id"]).collect()] == [(4, "x", 100.0)]


def test_whisker_stays_outside_the_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 10, 10, 10, 10.5]], "x double")
    made = profile.boxplots(df, ["x"]).first()
    assert (made.q1, made.q3, made.whisker_lo, made.whisker_hi, made.outliers) == (10.0, 10.0, 10.0, 10.0, 2)


@pytest.mark.parametrize("values", [[], [None], [5.0], [5.0, 5.0]])
def test_edge_frames(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    stats = profile.describe_stats(df, ["x"]).collect()
    boxes = profile.boxplots(df, ["x"]).collect()
    bins = profile.histograms(df, ["x"]).collect()
    assert len(stats) == len(boxes) == (1 if known else 0)
    if known:
        assert stats[0]["count"] == len(known) and stats[0]["std"] == (None if len(known) == 1 else 0.0)
        assert [(b.lo, b.hi, b.n) for b in bins] == [(4.5, 5.5, len(known))]
