"""Model outputs: pages on stored scores against their SQL, metrics and attributions against numpy, cluster profiles
against SQL over the stored labels."""
import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orbitcart.operators import churn, clv, segment
from orbitcart.plans import catalog_scores as C
from orbitcart.plans.jobs import jobs
from orbitcart.plans.registry import all_oracle_sql, all_queries
from orbitcart.session import written_table
from orbitcart.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"


def _view(con, name, df):
    """A DuckDB view of a small Spark frame."""
    con.register(name, df.toArrow())


@pytest.fixture(scope="module")
def con(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def _sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def test_churn_pages_read_the_stored_scores(spark, con):
    _view(con, "churn_scores", jobs(spark, SF).model_scored.select("customer_unique_id", "churn_probability"))
    for name in C.CHURN_PAGES:
        got = _rows(all_queries()[C.model_name(name)](spark, SF))
        assert got == _sql_rows(con, C.sql_over_scores(name)), name
    by_rule = _rows(all_queries()["I12_risk_distribution"](spark, SF))
    assert by_rule != _rows(all_queries()["I12_model_risk_distribution"](spark, SF))


def test_clv_pages_read_the_stored_predictions(spark, con):
    _view(con, "clv_scores", jobs(spark, SF).model_clv.select("customer_unique_id", "predicted_clv"))
    for name in C.CLV_PAGES:
        got = _rows(all_queries()[C.model_name(name)](spark, SF))
        assert got == _sql_rows(con, C.sql_over_scores(name)), name


def test_page_without_score_has_no_score_sql():
    with pytest.raises(ValueError):
        C.sql_over_scores("J11_fixed_tiers")


def test_cluster_profiles_equal_sql_over_stored_labels(spark, con):
    labels = jobs(spark, SF).clusters[1].select("customer_unique_id", "persona_title")
    _view(con, "cluster_labels", labels)
    renamed = "(SELECT fs.* REPLACE (c.persona_title AS rfm_segment) FROM fs JOIN cluster_labels c USING (customer_unique_id)) fs"
    digits = {"avg_spending": 6, "avg_orders": 6, "avg_recency": 6, "avg_clv": 6, "avg_aov": 6, "avg_csat": 6, "churn_pct": 6}
    for name, twin in (("H13_cluster_overview", "H13_segment_overview_rfm"), ("H14_cluster_details", "H14_segment_details_rfm")):
        sql = all_oracle_sql()[twin].replace("FROM master JOIN fs", f"FROM master JOIN {renamed}")
        head, tail = sql.rsplit(" FROM fs GROUP BY 1", 1)
        df = all_queries()[name](spark, SF)
        df = df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})
        assert _rows(df) == _sql_rows(con, f"{head} FROM {renamed} GROUP BY 1{tail}"), name


def test_projection_keeps_the_largest_variances(spark):
    """H3 the three axes hold the variance that numpy finds for the three largest eigenvalues."""
    data = jobs(spark, SF).seg_prepared[1]
    x = np.array([r.v for r in data.select(vector_to_array("features").alias("v")).collect()])
    p = np.array([tuple(r) for r in data.select("pca_x", "pca_y", "pca_z").collect()], dtype=float)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3]
    assert np.allclose(p.var(axis=0, ddof=1), values, rtol=1e-6)
    assert np.allclose(np.corrcoef(p.T), np.eye(3), atol=1e-6)


def test_chosen_k_has_the_best_silhouette(spark):
    rows = all_queries()["H4_k_selection"](spark, SF).collect()
    assert sum(r.chosen for r in rows) == 1
    assert all(-1 <= r.silhouette <= 1 for r in rows)


def test_classifier_metrics_equal_numpy(spark):
    """I5 on a fixed prediction table with ties."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    rows = [(float(a), [1 - float(b), float(b)], float(b >= 0.5)) for a, b in zip(y, p)]
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame(rows, f"{churn.LABEL} double, r array<double>, prediction double").withColumn(
        "rawPrediction", array_to_vector("r"))
    got = churn.evaluate_classifier(df, "m")
    hat = p >= 0.5
    tp = int((hat & (y == 1)).sum())
    precision, recall = tp / hat.sum(), tp / (y == 1).sum()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    exp = {"accuracy": (hat == y).mean(), "precision": precision, "recall": recall,
           "f1": 2 * precision * recall / (precision + recall), "roc_auc": auc}
    assert all(abs(got[k] - v) < 1e-4 for k, v in exp.items())


def test_regressor_metrics_equal_numpy(spark):
    """J5 on a fixed prediction table."""
    rng = np.random.default_rng(6)
    y = rng.random(300) * 1000
    h = y + rng.normal(0, 50, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, h)], f"{clv.TARGET} double, prediction double")
    got = clv.evaluate_regressor(df, "m")
    exp = {"mae": np.abs(y - h).mean(), "rmse": np.sqrt(((y - h) ** 2).mean()),
           "r2": 1 - ((y - h) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
           "explained_variance": 1 - (y - h).var() / y.var(), "mape": (np.abs(y - h) / np.maximum(y, 1)).mean() * 100}
    assert all(abs(got[k] - v) < 1e-3 for k, v in exp.items())


def test_split_is_repeatable_and_whole(spark):
    """I1 both parts together are the input, whatever its order."""
    fs = jobs(spark, SF).r.feature_store.select(churn.KEY, churn.LABEL)
    train, test = churn.split_train_test(fs)
    again, _ = churn.split_train_test(written_table(fs.orderBy(F.desc(churn.KEY)), "split"))
    ids = lambda df: {r[0] for r in df.select(churn.KEY).collect()}
    assert ids(train) == ids(again) and not ids(train) & ids(test)
    assert len(ids(train)) + len(ids(test)) == fs.count()


def test_model_tables(spark):
    """I4, J4: one row a model, the best first; J6 predictions are floored at 0."""
    for name, best in (("I4_churn_model_metrics", "roc_auc"), ("J4_clv_model_metrics", "r2")):
        rows = [r[best] for r in all_queries()[name](spark, SF).collect()]
        assert len(rows) == 3 and rows == sorted(rows, reverse=True)
    assert all_queries()["J6_clv_model_predictions"](spark, SF).filter("predicted_clv < 0 OR predicted_clv IS NULL").isEmpty()
    assert all_queries()["I7_churn_model_scores"](spark, SF).filter("churn_probability NOT BETWEEN 0 AND 1").isEmpty()


def test_cluster_rows_cover_every_customer(spark):
    """H11 sizes of the personas add up to the customers."""
    _, df, table = jobs(spark, SF).clusters
    assert df.count() == jobs(spark, SF).r.feature_store.count()
    assert df.filter("persona_title IS NULL").isEmpty()
    assert segment.cluster_summary(df).count() == df.select("cluster_id").distinct().count() and table.count() == 3
