import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguestats.functions import exprs


def column(spark, values, type_="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {type_}")


def apply(spark, values, make, type_="double"):
    return [r[0] for r in column(spark, values, type_).select(make(F.col("x"))).collect()]


def test_np_round_is_numpy(spark):
    values = sorted({h / a for a in range(1, 121) for h in range(a + 1)})
    assert apply(spark, values, lambda c: exprs.np_round(c, 3)) == list(np.round(values, 3))
    assert apply(spark, [1 / 16], lambda c: exprs.np_round(c, 3)) == [0.062]


def test_ratio(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (3, 0), (-3, 0), (None, 2)], "n int, d int")
    assert [r[0] for r in df.select(exprs.ratio(F.col("n"), F.col("d"))).collect()] == [0.5, None, None, None, None]
    flagged = [r[0] for r in df.select(exprs.ratio(F.col("n"), F.col("d"), inf_on_zero=True)).collect()]
    assert flagged == [0.5, None, math.inf, -math.inf, None]


def test_nan_and_infinity(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert apply(spark, values, exprs.no_nan) == [1.0, None, math.inf, -math.inf, None]
    assert apply(spark, values, exprs.finite) == [1.0, None, None, None, None]


def test_innings(spark):
    assert apply(spark, [5.0, 5.1, 5.2, 0.2, None], exprs.innings_to_decimal) == [5.0, 5.33, 5.67, 0.67, None]


def test_repair_innings_on_all_two_decimal_values(spark):
    values = [i / 100 for i in range(20000)]
    expected = [math.ceil(v) if np.isclose(v % 1, 0.99, atol=0.01) else v for v in values]
    assert apply(spark, values, exprs.repair_innings) == expected
    assert apply(spark, [0.99, 1.98, 1.34, 2.0], exprs.repair_innings) == [1.0, 2.0, 1.34, 2.0]


def test_format_stat_is_python_format(spark):
    random.seed(7)
    values = [random.randint(0, 3000) / random.choice([16, 80, 7, 1000, 2000]) for _ in range(3000)]
    expected = [str(int(v)) if v.is_integer() else f"{v:.3f}" for v in values]
    assert apply(spark, values, exprs.format_stat) == expected
    assert apply(spark, [3.0, 0.25, 0.0625, 0.1235, 1234567.5, None], exprs.format_stat) == [
        "3", "0.250", "0.062", "0.123", "1234567.500", None,
    ]


@pytest.mark.parametrize("keep, expected", [(False, ["A", None, None]), (True, ["A", "other", None])])
def test_lookup(spark, keep, expected):
    made = apply(spark, ["alpha", "other", None], lambda c: exprs.lookup(c, {"alpha": "A"}, keep), "string")
    assert made == expected


def test_plain_number_is_python_text(spark):
    random.seed(3)
    values = [0.0, 1.0, 450.0, 0.321, 12345678.0, 98765432.25, 0.0005, 0.00025, -0.0005, -23456789.5]
    values += [float(random.randint(10**7, 10**12)) for _ in range(200)] + [random.randint(1, 99) / 10**5 for _ in range(50)]
    expected = [repr(v) if "e" not in repr(v) else f"{v:.18f}".rstrip("0") for v in values]
    assert apply(spark, values, exprs.plain_number) == expected
    assert apply(spark, [None], exprs.plain_number) == [None]
