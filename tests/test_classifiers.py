"""All experiments in one fit against one fit after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import classifiers, metrics, splits


@pytest.fixture(scope="module", params=[2, 4])
def table(spark, request):
    r = np.random.default_rng(request.param)
    centre = r.normal(0, 1, (request.param, 5))
    rows = [("n%03d" % i, [float(x) for x in centre[i % request.param] + r.normal(0, 1.2, 5)], "c%d" % (i % request.param)) for i in range(240)]
    df = spark.createDataFrame(rows, "node string, vec array<double>, label string").repartition(3)
    return request.param, metrics.node_rows(df.select("node", "vec"), df.select("node", "label")).cache()


def test_folds_are_those_of_each_experiment(table):
    _, rows = table
    for stratify in (True, False):
        dealt = metrics.all_node_folds(rows, 3, 0.6, stratify).collect()
        for k in range(3):
            want = {r.node: r.split for r in metrics.node_folds(rows, k, 0.6, stratify).collect()}
            assert {r.node: "train" if k in r.train else "test" for r in dealt} == want
            assert all((k in r.train) != (k in r.test) for r in dealt)


def test_coefficients_of_spark_ml(spark, table):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    classes, rows = table
    dealt = metrics.all_node_folds(rows, 3, 0.5).cache()
    fit = classifiers.Fit(dealt, 3, classes, 5, c=0.7, max_iter=300, tol=1e-10)
    for k in range(2):
        train = dealt.where(F.array_contains("train", k)).withColumn("v", array_to_vector("feats"))
        model = LogisticRegression(featuresCol="v", regParam=1 / (0.7 * train.count()), standardization=False, maxIter=500, tol=1e-14).fit(train)
        got, base = model.coefficientMatrix.toArray(), np.array(model.interceptVector)
        mine = fit.w[k]
        assert np.allclose(mine[:, :-1], got, atol=1e-6)
        shift = 0 if classes == 2 else mine[:, -1].mean()
        assert np.allclose(mine[:, -1] - shift, base, atol=1e-6)
        test = dealt.where(F.array_contains("test", k)).withColumn("v", array_to_vector("feats"))
        assert abs(fit.accuracies()[k] - metrics.accuracy(model.transform(test))) < 1e-12


def test_many_experiments_take_no_more_jobs(spark, table):
    classes, rows = table
    few = classifiers.Fit(metrics.all_node_folds(rows, 2).cache(), 2, classes, 5, max_iter=15)
    many = classifiers.Fit(metrics.all_node_folds(rows, 300).cache(), 300, classes, 5, max_iter=15)
    assert many.evaluations <= few.evaluations + 12
    assert np.allclose(few.w, many.w[:2], atol=1e-3) and len(many.accuracies()) == 300


def test_other_splits_change_the_result(spark, table):
    classes, rows = table
    named = rows.select("node", F.col("feats").alias("vec")), rows.select("node", F.col("label").cast("string").alias("label"))
    few = metrics.node_classification(*named, experiments=2, split=lambda r, seed: splits.n_per_class(r, "node", "label", 2, 0, seed=seed), max_iter=20)
    half = metrics.node_classification(*named, experiments=2, max_iter=20)
    a, b = ([r.accuracy for r in x.orderBy("experiment").collect()] for x in (few, half))
    assert len(a) == len(b) == 2 and a != b and all(0.3 < x <= 1 for x in a + b)
