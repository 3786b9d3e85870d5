import math

import pytest
from pyspark.sql import functions as F

from decidra.functions import prob as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_codecs(spark):
    assert value(spark, P.choice_confidence(arr(0.03, 0.01, 0.4, 0.23, 0.01, 0.3, 0.005, 0.015))) == pytest.approx(0.3142857142857143)
    keys = F.array(F.lit("a"), F.lit("b"))
    assert value(spark, P.restrict(F.create_map(F.lit("a"), F.lit(2.0)), keys)) == [1.0, 0.0]
    assert value(spark, P.restrict(F.create_map().cast("map<string,double>"), keys)) == [0.5, 0.5]
    assert value(spark, P.score_value(arr(0.1, 0.3, 0.6))) == pytest.approx(1.5)
    null = F.lit(None)
    levels = F.array(F.lit("0"), F.lit("1"), F.lit("2"))
    got = P.from_answer(F.lit("score"), levels, null.cast("double"), null.cast("string"), F.lit(1.4), null.cast("map<string,double>"))
    assert value(spark, got) == [0.0, 1.0, 0.0]
    got = P.from_answer(F.lit("noul"), levels, F.lit(1.7), null.cast("string"), null.cast("double"), null.cast("map<string,double>"))
    assert value(spark, got) == [0.0, 1.0]


def test_pair_metrics(spark):
    ps, label = arr(0.5, 0.5 - 1e-9, 1e-9), F.lit(1)
    ref = arr(0.8, 0.15, 0.05)
    assert value(spark, P.tie_credit(ps, label)) == 1.0
    assert value(spark, P.nll(ps, label)) == pytest.approx(math.log(2))
    assert value(spark, P.brier(ps, label)) == pytest.approx(0.5)
    assert value(spark, P.total_variation(ref, ps)) == pytest.approx(0.35)
    assert value(spark, P.tie_credit(arr(1 / 3, 1 / 3, 1 / 3), label)) == pytest.approx(1 / 3)
    assert value(spark, P.kl(ref, ref)) == pytest.approx(0)
    assert value(spark, P.score_error(arr(0, 1, 0), arr(0, 0, 1))) == pytest.approx(0.5)


def test_rescale_and_shapes(spark):
    assert value(spark, P.rescale(arr(0.6, 0.4), F.lit(1.0))) == [0.6, 0.4]
    sharp = value(spark, P.rescale(arr(0.6, 0.4), F.lit(0.5)))
    assert sharp[0] == pytest.approx(0.36 / 0.52)
    assert value(spark, P.two_level(F.lit(2.5), 6)) == [0, 0, 0.5, 0.5, 0, 0]
    assert value(spark, P.two_level(F.lit(5.0), 6)) == [0, 0, 0, 0, 0, 1]
    assert value(spark, P.smooth(arr(1, 0))) == pytest.approx([0.975, 0.025])


def test_nan_is_unanswered(spark):
    assert value(spark, P.valid(arr(float("nan"), 1))) is False
    assert value(spark, P.valid(F.lit(None).cast("array<double>"))) is False
