import datetime as dt
import math

import pytest

from airshed.operators.crossval import cross_validate, cv_summary, fold_results, metrics_long, r2_by
from airshed.operators.estimators import GroupMeanRegressor
from airshed.operators.split import assign_folds, cut_keys, fold_starts, key_hash, row_key, split_exact, split_hash


def keyed(spark, n, cities=("A", "B", "C")):
    base = dt.datetime(2024, 1, 1)
    data = [(base + dt.timedelta(hours=6 * i), cities[i % len(cities)], float(i % 7)) for i in range(n)]
    return spark.createDataFrame(data, "time timestamp_ntz, city string, label double")


def test_exact_split_size(spark):
    out = split_exact(keyed(spark, 11), 0.2, 42)
    assert out.where("is_test").count() == 3
    assert out.where("not is_test").count() == 8


def test_split_independent_of_partitioning(spark):
    df = keyed(spark, 200)
    a = {(r.time, r.city) for r in split_exact(df, 0.2, 42).where("is_test").collect()}
    b = {(r.time, r.city) for r in split_exact(df.repartition(7, "label"), 0.2, 42).where("is_test").collect()}
    assert a == b and len(a) == 40
    h1 = {(r.time, r.city) for r in split_hash(df, 0.2, 42).where("is_test").collect()}
    h2 = {(r.time, r.city) for r in split_hash(df.repartition(5), 0.2, 42).where("is_test").collect()}
    assert h1 == h2


def test_split_is_a_partition(spark):
    df = keyed(spark, 97)
    out = split_exact(df, 0.2, 7)
    assert out.count() == 97
    assert out.select("time", "city").distinct().count() == 97


def test_fold_sizes(spark):
    out = assign_folds(keyed(spark, 13), 5, 42)
    sizes = sorted(((r.fold, r["count"]) for r in out.groupBy("fold").count().collect()))
    assert [s for _, s in sizes] == [3, 3, 3, 2, 2]
    out = assign_folds(keyed(spark, 1003), 5, 42)
    sizes = [r["count"] for r in out.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [201, 201, 201, 200, 200]


def test_cut_keys_match_sorted_order(spark, monkeypatch):
    from airshed.operators import split
    df = keyed(spark, 500)
    h = key_hash(42)
    order = sorted(r[0] for r in df.select(row_key(df, h)).collect())
    want = [0, 1, 99, 250, 499, 500, 501]
    for small, digits in ((1000, 4), (1, 1), (3, 2)):  # look in early, or only at full keys
        monkeypatch.setattr(split, "SMALL", small)
        monkeypatch.setattr(split, "DIGITS", digits)
        got, n = cut_keys(df, h, lambda n: want)
        assert n == 500
        assert got == [order[r] if r < 500 else None for r in want]


def test_no_rows(spark):
    df = keyed(spark, 5).where("false")
    assert split_exact(df, 0.2, 42).count() == 0 and assign_folds(df, 5, 42).count() == 0


def r2_of(spark, ys, ps):
    df = spark.createDataFrame([(1, float(y), float(p)) for y, p in zip(ys, ps)],
                               "g int, label double, prediction double")
    return r2_by(df, ["g"]).first().r2


def test_r2_rules(spark):
    assert r2_of(spark, [1, 2, 3], [1, 2, 3]) == 1.0
    assert r2_of(spark, [1, 2, 3], [2, 2, 2]) == 0.0
    assert r2_of(spark, [5, 5, 5], [5, 5, 5]) == 1.0
    assert r2_of(spark, [5, 5, 5], [5, 6, 5]) == 0.0


def test_summary_population_std(spark):
    folds = spark.createDataFrame([(1, 1.0, 1.0, 0.0), (2, 2.0, 2.0, 0.0), (3, 4.0, 4.0, 0.0)],
                                  "Fold int, Train_R2 double, CV_R2 double, Gap double")
    s = cv_summary(folds).first()
    assert round(s.std_cv_r2, 6) == 1.247219
    assert s.best_fold_r2 == 4.0 and s.worst_fold_r2 == 1.0 and s.generalization_gap == 0.0
    m = metrics_long("x", folds, cv_summary(folds))
    assert m.count() == 9 + 3 * 3
    assert m.columns == ["model", "metric", "value"]


def test_cross_validate_group_mean(spark):
    df = assign_folds(keyed(spark, 300), 5, 42)
    r2 = cross_validate(df, GroupMeanRegressor(groupCol="city"), 5)
    assert r2.count() == 10
    ft = fold_results(r2).orderBy("Fold").collect()
    assert [r.Fold for r in ft] == [1, 2, 3, 4, 5]
    for r in ft:
        assert math.isclose(r.Gap, r.Train_R2 - r.CV_R2)


@pytest.mark.parametrize("name,target", [("pm25_predictor", "pm2_5"), ("pm10_forecaster", "pm10")])
def test_variants_only_differ_by_name_and_target(name, target):
    from airshed.params import MODEL_VARIANTS
    assert MODEL_VARIANTS[name] == target
    assert set(MODEL_VARIANTS) == {"pm25_predictor", "pm10_predictor", "pm25_forecaster", "pm10_forecaster"}


def test_hot_key_with_other_values_is_split_exactly(spark):
    """A third of the rows share one key (values differ): exact sizes hold."""
    base = dt.datetime(2024, 1, 1)
    rows = ([(base, "HOT", float(i)) for i in range(300)]
            + [(base + dt.timedelta(hours=i), "C", 1.0) for i in range(600)])
    df = spark.createDataFrame(rows, "time timestamp_ntz, city string, label double").repartition(6)
    out = split_exact(df, 0.2, 42)
    assert out.where("is_test").count() == 180
    folds = [r["count"] for r in assign_folds(df, 5, 42).groupBy("fold").count().collect()]
    assert sorted(folds) == [180] * 5


def test_identical_rows_stay_together(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base, "HOT", 1.0)] * 50 + [(base + dt.timedelta(hours=i), "C", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, city string, label double")
    out = split_exact(df, 0.5, 42)
    assert out.where("city = 'HOT'").select("is_test").distinct().count() == 1
    assert out.count() == 100


def _py_ntile(n, k):
    """SQL ntile: the first n % k buckets get one extra row."""
    q, r = divmod(n, k)
    out = []
    for b in range(1, k + 1):
        out += [b] * (q + (1 if b <= r else 0))
    return out


def test_ntile_arithmetic_exhaustive():
    for k in range(1, 8):
        for n in range(60):
            starts = fold_starts(n, k)
            assert [1 + sum(r >= c for c in starts) for r in range(n)] == _py_ntile(n, k), (n, k)


def test_metric_names(spark):
    folds = spark.createDataFrame([(i, 0.9, 0.5, 0.4) for i in range(1, 6)],
                                  "Fold int, Train_R2 double, CV_R2 double, Gap double")
    extra = spark.createDataFrame([("test_r2", 0.5)], "metric string, value double")
    names = {r.metric for r in metrics_long("m", folds, cv_summary(folds), extra).collect()}
    expected = {"mean_train_r2", "mean_cv_r2", "generalization_gap", "std_train_r2", "std_cv_r2",
                "best_fold_r2", "worst_fold_r2", "best_train_r2", "worst_train_r2", "test_r2"}
    expected |= {f"fold_{i}_{m}" for i in range(1, 6) for m in ("train_r2", "cv_r2", "gap")}
    assert names == expected
