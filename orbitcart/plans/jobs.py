"""Batch-job outputs shared by several queries (model fits, mined itemsets, scores).

Each output is computed once per (session, folder) and checkpointed to the shared
checkpoint folder, so dependent queries read a short plan instead of refitting.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from orbitcart.functions.ordering import packed
from orbitcart.operators import basket, churn, clv, density, distinct
from orbitcart.operators import recommend as reco
from orbitcart.operators import search
from orbitcart.operators import segment as seg
from orbitcart.plans.pipeline import Retail, retail
from orbitcart.session import scratch_table_path, written_table
from orbitcart.sources import warehouse

#: Features and radius of the density clusters that SQL can check.
DENSITY_FEATURES, DENSITY_EPS = ("recency_days", "total_spending", "avg_order_value"), 0.25

_MEMO: dict[tuple[int, str], "Jobs"] = {}


class Jobs:
    def __init__(self, r: Retail):
        self.r = r

    def _cut(self, df: DataFrame) -> DataFrame:
        return self.r._cut(df)

    # ---- L: market basket
    @cached_property
    def baskets(self) -> DataFrame:
        return self._cut(basket.baskets(self.r.master))

    @cached_property
    def itemsets(self) -> DataFrame:
        return self._cut(basket.frequent_itemsets(self.baskets, basket.DEFAULT_MIN_SUPPORT))

    @cached_property
    def rules(self) -> DataFrame:
        return self._cut(basket.association_rules(self.itemsets, 1.0))


    # ---- I: churn (rule probability path; the model path is ``churn_model``)
    @cached_property
    def scored(self) -> DataFrame:
        df = churn.rule_probability(self.r.feature_store)
        return self._cut(churn.with_retention_actions(churn.with_risk(df)))

    @cached_property
    def churn_model(self):
        """(best PipelineModel, metrics) from the model comparison."""
        return churn.train_churn_models(self.r.feature_store)

    @cached_property
    def model_scored(self) -> DataFrame:
        """The stored score table of the best churn model; the pages take it like ``scored``."""
        model, _ = self.churn_model
        df = churn.churn_probability(model, churn.prepare_labels(self.r.feature_store))
        return written_table(churn.with_retention_actions(churn.with_risk(df)), "churn-scores")

    # ---- J: CLV (closed-form prediction path; the model path is ``clv_model``)
    @cached_property
    def clv_frame(self) -> DataFrame:
        base = clv.rule_predicted_clv(clv.clv_features(self.r.feature_store))
        tiered = clv.value_tiers(base, "predicted_clv")
        return self._cut(clv.opportunities(tiered))

    @cached_property
    def clv_model(self):
        return clv.train_clv_models(self.r.feature_store)

    @cached_property
    def model_clv(self) -> DataFrame:
        """The stored predictions of the best CLV model with tiers and opportunities, as ``clv_frame``."""
        model, _ = self.clv_model
        predicted = written_table(clv.predict_clv(model, self.r.feature_store), "clv-predictions")
        return self._cut(clv.opportunities(clv.value_tiers(predicted, "predicted_clv")))

    # ---- K: recommender
    @cached_property
    def popularity(self) -> DataFrame:
        return self.r._stored(reco.popularity(self.r.items), "popularity")

    @cached_property
    def interactions(self) -> DataFrame:
        return self.r._stored(reco.interactions(self.r.items, self.popularity), "interactions")

    @cached_property
    def neighbours(self) -> DataFrame:
        return self.r._stored(reco.neighbours(self.interactions), "neighbours")

    @cached_property
    def affinity(self) -> DataFrame:
        return self.r._stored(reco.content_affinity(self.interactions, reco.category_similarity(self.popularity)), "affinity")

    @cached_property
    def recommendations(self) -> DataFrame:
        """K6 + K7 for every customer: hybrid top-5, cold start for the rest."""
        hyb = reco.with_product_info(reco.recommend(self.interactions, self.neighbours, self.affinity, self.popularity, 5), self.popularity)
        cold = reco.cold_start(self.r.feature_store, hyb, self.popularity, 5)
        cols = ["customer_unique_id", "product_id", "category", "avg_price", "hybrid_score", "rec_rank",
                "explanation", "recommendation_type"]
        return self.r._stored(hyb.select(*cols).unionByName(cold.select(*cols)), "recommendations")


    # ---- M15: search
    @cached_property
    def entities(self) -> DataFrame:
        return self.r._stored(search.entities(self.r.search_items, self.r.feature_store), "entities")

    @cached_property
    def gram_index(self) -> DataFrame:
        return self.r._stored(search.gram_index(self.entities), "gram-index")


    # ---- M: stored tables for slices
    @cached_property
    def warehouse(self) -> str:
        """Path of the master laid out in blocks with a zone map."""
        return warehouse.write_clustered(self.r.master, scratch_table_path(self.r.spark, f"warehouse-{uuid.uuid4().hex}"))

    @cached_property
    def distinct_state(self) -> DataFrame:
        return distinct.distinct_state(self.r.items, written_table)


    # ---- H: segmentation
    @cached_property
    def seg_prepared(self):
        model, data = seg.prepared(self.r.feature_store)
        # checkpointed (short lineage) and kept in memory across the k-selection and benchmark fits
        return model, self.r._keep(packed(self._cut(data)))

    @cached_property
    def seg_k(self):
        return seg.choose_k(self.seg_prepared[1])

    @cached_property
    def dense_pca(self) -> DataFrame:
        """H8 density clusters of the customers on the PCA axes."""
        points = self.seg_prepared[1].select(seg.KEY, "pca_x", "pca_y", "pca_z")
        return density.density_clusters(points, ["pca_x", "pca_y", "pca_z"], id_col=seg.KEY, written=written_table)

    @cached_property
    def dense_features(self) -> DataFrame:
        """H8 density clusters of the customers on three standardised features."""
        points = density.standardised(self.r.feature_store.select(seg.KEY, *DENSITY_FEATURES), DENSITY_FEATURES)
        return density.density_clusters(points, DENSITY_FEATURES, id_col=seg.KEY, eps=DENSITY_EPS, written=written_table)

    @cached_property
    def clusters(self):
        """(best algorithm, customers with cluster_id + persona_title, benchmark table)."""
        data = self.seg_prepared[1]
        best, pred, table = seg.benchmark(data, self.seg_k[0])
        pers = seg.personas(seg.cluster_summary(pred))
        out = pred.join(pers.select("cluster_id", "persona_title"), "cluster_id", "left")
        keep = [c for c in out.columns if c not in ("raw_features", "features", "centred", "pca", "probability")
                and not c.endswith("__imp")]
        return best, self._cut(out.select(*keep)), table


def jobs(spark: SparkSession, sf_dir: str) -> Jobs:
    r = retail(spark, sf_dir)
    key = (id(spark), r.sf_dir)
    j = _MEMO.get(key)
    if j is None or j.r is not r:
        j = Jobs(r)
        _MEMO[key] = j
    return j
