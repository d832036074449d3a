import numpy as np
import pytest
from pyspark.sql import functions as F

from warpspark import errors
from warpspark.functions import dtw as D
from warpspark.functions import kernels as K
from warpspark.functions import series as S
from warpspark.rng import uniform, uniform_value


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 12)), rng.normal(size=(30, 12))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a array<double>, b array<double>")


def column(df, c):
    return np.array([r[1] for r in df.select("id", c).orderBy("id").collect()])


def test_native_functions_match_numpy(table):
    x, y, df = table
    a, b = F.col("a"), F.col("b")
    assert np.allclose(column(df, S.z_normalize(a)), (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
    assert np.allclose(column(df, S.derivative(a)), ((x[:, 1:-1] - x[:, :-2]) + (x[:, 2:] - x[:, :-2]) / 2) / 2)
    for r in (0, 2, None):
        up, low = K.envelopes(x, r)
        assert np.allclose(column(df, S.envelope(a, r)["upper"]), up) and np.allclose(column(df, S.envelope(a, r)["lower"]), low)
        uy, ly = K.envelopes(y, r)
        assert np.allclose(column(df, S.lb_keogh(a, S.envelope(b, r))), K.lb_keogh(x, uy, ly))
        assert np.allclose(column(df, D.dtw(a, b, r)), K.dtw(x, y, r))
    assert np.allclose(column(df, D.dtw_native(a, b, 2)), K.dtw(x, y, 2))
    cut = F.lit(3.0)
    assert np.array_equal(column(df, D.dtw_pruned(a, b, cut, 2)), np.where(K.dtw(x, y, 2) < 3.0, K.dtw(x, y, 2), np.inf))


def test_false_bound_is_kept_as_a_figure_only(spark):
    df = spark.createDataFrame([(0, [0.0] * 4, [5.0] * 4)], "id long, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.lb_improved_compat(a, S.envelope(a, 2), b, S.envelope(b, 2)), D.dtw(a, b, 2), D.dtw_pruned(a, b, F.lit(12.0), 2)).first()
    assert got[0] == pytest.approx(200**0.5) and got[1] == 10 and got[2] == 10


def test_unequal_lengths_and_paths(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [1.0, 3.0]), (1, [1.0], [5.0])], "id long, a array<double>, b array<double>")
    assert [r[0] for r in df.orderBy("id").select(D.dtw(F.col("a"), F.col("b"))).collect()] == [1.0, 4.0]
    steps = df.filter("id = 0").select(D.dtw_path(F.col("a"), F.col("b"))).first()[0]
    assert [(s["a"], s["b"]) for s in steps] == [(0, 0), (1, 0), (2, 1)]


def test_preprocess_errors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, [5.0, 5.0, 5.0])], "id long, series array<double>")
    with pytest.raises(errors.ConstantSeries):
        S.preprocess(df, normalize=True)
    with pytest.raises(errors.TooShort):
        S.preprocess(spark.createDataFrame([(0, [1.0, 2.0])], df.schema), slope=True)
    with pytest.raises(errors.NonFiniteValue):
        S.require_valid(spark.createDataFrame([(0, [1.0, float("nan")])], df.schema))
    with pytest.raises(errors.EmptySeries):
        S.require_valid(spark.createDataFrame([(0, [])], df.schema))
    got = S.preprocess(spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0, 4.0])], df.schema), slope=True).first()["series"]
    assert got == [1.0, 1.0, 1.0]


def test_ranking_impurity_and_edges(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2], [5, 5], [10, 0, 0])], "p array<double>, c array<long>, d array<long>")
    row = df.select(S.top_k(F.col("p"), 2).alias("t"), S.predicted_class(F.col("p")).alias("k"), S.gini(F.col("c")).alias("g"), S.gini(F.col("d")).alias("z"), S.entropy(F.col("c")).alias("e")).first()
    assert [t["class"] for t in row["t"]] == [0, 1] and row["k"] == 1 and row["g"] == 0.5 and row["z"] == 0 and row["e"] == pytest.approx(np.log(2))
    values = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert values.agg(S.quantile_edges(F.col("v"), 4)).first()[0] == [3.25, 5.5, 7.75]
    assert values.select(F.lit(5.0).alias("v")).agg(S.quantile_edges(F.col("v"), 4)).first()[0] == []
    assert df.select(S.bin_index(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.0))).first()[0] == 1


def test_sql_functions_and_keyed_numbers(spark):
    D.register(spark)
    assert spark.sql("SELECT dtw(array(0D, 1D), array(1D, 0D), 0)").first()[0] == pytest.approx(2**0.5)
    assert spark.sql("SELECT z_normalize(array(1D, 3D))").first()[0] == [-1.0, 1.0]
    assert spark.sql("SELECT derivative(array(0D, 1D, 2D))").first()[0] == [1.0]
    assert spark.range(3).select(uniform(7, "x", F.col("id"))).collect()[2][0] == uniform_value(7, "x", 2)
