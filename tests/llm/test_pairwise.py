import numpy as np
from pyspark.sql import functions as F

from orbitcart.llm import pairwise, queries

SMOKE_DIR = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_fold(spark):
    import zlib
    rows = queries.op2_bradley_terry_quality(spark, SMOKE_DIR).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMOKE_DIR}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in unseen]) >= 0.95


def test_features_of_plain_and_junk_texts():
    names = dict(zip(pairwise.FEATURES, pairwise.text_features("one | two | two two\none | two")))
    assert names["lone_signs"] == 3 / 9 and names["same_as_last"] == 1 / 9
    assert pairwise.text_features("") == [0.0] * len(pairwise.FEATURES) == pairwise.text_features(" \n\t")


def test_unusual_rows(spark, awkward):
    docs = awkward([(1, None), (2, ""), (2, "again"), (None, "no id"), (3, "word " * 30_000)])
    model = pairwise.Model((0.1,) * len(pairwise.FEATURES), 0.2)
    scored = pairwise.score(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    kept = pairwise.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in scored)
    assert docs.select(pairwise.held_out(F.col("doc_id")).alias("h")).filter("h IS NULL").count() == 0
    assert pairwise.score(docs.limit(0), model).count() == 0


def test_without_both_labels_everything_is_kept(spark, awkward):
    docs = awkward([(1, "some words"), (2, "other words")])
    for labels in ([], [(1, 1), (2, 1)], [(None, 0), (1, None)]):
        model = pairwise.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r.score for r in pairwise.score(docs, model).collect()] == [0.5, 0.5]


def test_labels_given_twice_count_by_majority(spark, awkward):
    good, bad = "plain words in a text of some length", "junk junk junk junk junk junk junk"
    docs = awkward([(i, good + f" number {i}") for i in range(20)] + [(100 + i, bad) for i in range(20)])
    labels = [(i, 1) for i in range(20)] + [(i, 1) for i in range(20)] + [(3, 0)] + [(100 + i, 0) for i in range(20)]
    model = pairwise.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.doc_id for r in pairwise.score(docs, model).filter("score >= 0.5").collect()} == set(range(20))


def _documents(spark, awkward, n=60):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "Gamma", "delta", "x1", "##", "|", "wow!", "$$$", "plain"]
    rows = [(i, " ".join(rng.choice(words[:6] if i % 2 else words[2:], rng.integers(5, 60)))) for i in range(n)]
    return awkward(rows), spark.createDataFrame([(i, int(i % 2)) for i in range(n)], "doc_id long, quality int")


def test_weights_minimise_the_loss_over_all_pairs(spark, awkward):
    """With few rows every good document meets every bad one; Newton steps in numpy find the same weights."""
    docs, labels = _documents(spark, awkward)
    model = pairwise.fit(docs, labels)
    found = {r.doc_id: np.array(pairwise.text_features(r.text)) for r in docs.collect()}
    good, bad = ([found[i] for i in sorted(found) if i % 2 == side] for side in (1, 0))
    turned = docs.sparkSession.createDataFrame([(a.tolist(), b.tolist()) for a in good for b in bad], "x array<double>, y array<double>")
    turned = turned.withColumn("t", F.pmod(F.xxhash64("x", "y"), F.lit(2)) == 1).collect()
    x = np.array([np.subtract(r.y, r.x) if r.t else np.subtract(r.x, r.y) for r in turned])
    label = np.array([0.0 if r.t else 1.0 for r in turned])
    spread = x.std(axis=0, ddof=1)
    used = spread > 0
    z, w = x[:, used] / spread[used], np.zeros(used.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (p - label) / len(z) + 1e-3 * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(z) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    exp = np.zeros(len(used))
    exp[used] = w / spread[used]
    own = np.array([found[i] for i in sorted(found)])
    assert np.allclose(own @ np.array(model.weights), own @ exp, atol=0.02 * np.ptp(own @ exp))


def test_sample_depends_on_ids_alone(spark, awkward):
    docs, labels = _documents(spark, awkward)
    models = [pairwise.fit(docs, rows, sample_rows=30) for rows in (labels, labels.orderBy(F.desc("doc_id")).repartition(7))]
    assert np.allclose(models[0].weights, models[1].weights, rtol=1e-6, atol=1e-9)
    assert models[0].weights != pairwise.fit(docs, labels).weights


def test_every_labelled_document_counts(spark, awkward):
    """More labelled documents than the former sample of 20,000: the threshold comes from all of them."""
    words = ["alpha", "beta", "Gamma", "delta", "x1", "##", "|", "wow!", "$$$", "plain"]
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(words[:6] if i % 2 else words[2:], 3 + i % 7)) for i in range(21_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pairwise.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(21_000)], "doc_id long, quality int"))
    raw = np.array([pairwise.text_features(t) for t in texts]) @ np.array(model.weights)
    bad, good = np.quantile(raw[0::2], pairwise.BAD_QUANTILE), np.quantile(raw[1::2], pairwise.GOOD_QUANTILE)
    assert abs(model.threshold - (bad + good) / 2) < 1e-9 * max(1.0, abs(model.threshold))


def test_fit_sends_no_texts_to_the_labels(spark, monkeypatch):
    """Features are made before the join, so no text is shuffled; rows without id or label are left out."""
    seen, own = [], pairwise.with_features

    def watch(rows):
        seen.append(rows)
        return own(rows)

    monkeypatch.setattr(pairwise, "with_features", watch)
    docs = spark.createDataFrame([(i, "good words of a calm line " + "and more " * i if i % 2 else "BAD !!! $$$ BAD " + "!!! " * i) for i in range(40)] + [(None, "no id"), (99, "no label")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    model = pairwise.fit(docs, labels)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "Join" not in plan
    got = {r.doc_id: r.score for r in pairwise.score(docs, model).collect()}
    assert got[1] > got[0]
