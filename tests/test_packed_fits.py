"""Fits and stored customer frames take their rows in as many partitions as they fill."""
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from orbitcart.operators import churn
from orbitcart.plans import pipeline


def _store(spark, n=400, parts=40):
    i = F.col("id").cast("double")
    columns = {c: F.when(F.col("id") % 17 != k, (i * (k + 3)) % (11 + k)) for k, c in enumerate(churn.CHURN_FEATURES)}
    return spark.range(0, n, 1, parts).withColumns(columns | {churn.KEY: F.col("id"), churn.LABEL: (F.col("id") * 7 % 5 < 2).cast("int")})


@pytest.fixture
def fitted_on(monkeypatch):
    """Partitions that each classifier was fitted on."""
    seen = {}
    for kind in (GBTClassifier, LogisticRegression, RandomForestClassifier):
        def fit(self, dataset, _fit=kind._fit, _kind=kind):
            seen[_kind.__name__] = dataset.rdd.getNumPartitions()
            return _fit(self.copy({self.maxIter: 3}) if _kind is GBTClassifier else self, dataset)
        monkeypatch.setattr(kind, "_fit", fit)
    return seen


def test_small_frames_are_boosted_in_few_partitions(spark, fitted_on):
    """Before, each of hundreds of stages had a task for each partition of the store, 40 here."""
    train, _ = churn.split_train_test(churn.class_weights(churn.prepare_labels(_store(spark))))
    models = churn.fit_churn_models(train, ("logistic", "random_forest", "gbt"))
    assert fitted_on == {"LogisticRegression": 1, "RandomForestClassifier": 40, "GBTClassifier": 1}
    rows = train.count()
    for model in models.values():
        assert model.transform(train).where("prediction IS NOT NULL").count() == rows


def test_retraining_decides_on_all_rows(spark, fitted_on):
    fs = _store(spark)
    train, hold = churn.split_train_test(churn.class_weights(churn.prepare_labels(fs)), seed=7)
    incumbent = churn.churn_pipeline("logistic", seed=7).fit(train)
    fitted_on.clear()
    chosen, decision = churn.retrain_and_promote(incumbent, fs)
    assert fitted_on == {"LogisticRegression": 1}
    got = decision.first()
    assert chosen is incumbent and not got["promoted"]  # the same rows give the same model
    assert got["incumbent_auc"] == got["candidate_auc"] and train.count() + hold.count() == fs.count()


def test_stored_customer_frames_follow_their_rows(spark):
    """Before, a stored frame kept all shuffle partitions, and each pass over it had as many tasks."""
    r = pipeline.Retail(spark, "/nowhere")
    large, small = spark.range(0, 120_000, 1, 40), spark.range(0, 50, 1, 40)
    stored = r._cut(large.withColumn("x", F.col("id") % 7))
    assert stored.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 3)
    assert stored.count() == 120_000 and stored.agg(F.sum("id")).first()[0] == sum(range(120_000))
    assert r._cut(small).rdd.getNumPartitions() == 40  # random draws of fits on small frames stay as they are
