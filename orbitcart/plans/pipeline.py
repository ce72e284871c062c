"""The batch ETL as one lazy plan: canonical tables -> clean -> master -> features -> labels.

``Retail`` holds the frames for one input folder. The master is persisted (MEMORY_AND_DISK)
because every dashboard query reads it; a lost executor's blocks are recomputed from lineage.
Customer features and recommendations read ``items`` instead, the few columns of the master that
they need: Spark leaves the others out of every exchange, and the stored Parquet table keeps no
shuffle files alive. The customer features and the labelled feature store (one row per
customer) are checkpointed to the shared checkpoint folder. Frames are memoised per
(session, folder) so all registered queries share them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from orbitcart.functions.ordering import materialize
from orbitcart.operators import clean, features, labels, master
from orbitcart.session import release_shuffles, written_table
from orbitcart.sources import testdata

_MEMO: dict[tuple[int, str], "Retail"] = {}

#: Columns of the master that customers, baskets and recommendations are made of.
ITEM_COLUMNS = ("order_id", "customer_unique_id", "customer_city", "customer_state", "order_purchase_timestamp",
                "order_item_id", "product_id", "product_category_name_english", "price", "freight_value",
                "preferred_payment_type", "avg_review_score")


#: Columns of the master that the search's entities are made of.
SEARCH_COLUMNS = ("order_id", "customer_unique_id", "seller_id", "product_id", "product_category_name_english", "price",
                  "order_status", "order_purchase_timestamp", "seller_state")

#: Columns of the orders that the items need.
ORDER_COLUMNS = ("order_id", "customer_id", "order_purchase_timestamp")


class Retail:
    def __init__(self, spark: SparkSession, sf_dir: str, persist: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.persist = persist

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    def _cut(self, df: DataFrame) -> DataFrame:
        """Materialise a customer-level frame in the shared checkpoint folder.

        Label statistics embed their input plan in scalar subqueries and rank joins; reading
        them back from a checkpoint keeps every downstream plan short and lets a lost
        executor's work be re-read instead of recomputed from the raw tables. Its partitions follow
        the rows, as statistics and fits make many passes, each of which costs the driver a result a task.
        """
        return materialize(df, join=True)

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        """A stored table of all rows; the shuffle files that it took are let go."""
        out = written_table(df, name)
        del df
        release_shuffles(self.spark)
        return out

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return testdata.canonical_tables(self.spark, self.sf_dir)

    @cached_property
    def cleaned(self) -> dict[str, DataFrame]:
        return clean.clean_all(self.raw)

    @cached_property
    def master(self) -> DataFrame:
        return self._keep(master.build_master(self.cleaned))

    @cached_property
    def items(self) -> DataFrame:
        """All rows of the master, with the columns ``ITEM_COLUMNS``, as a stored table.

        Orders lose the other columns before they are cleaned, so that delivery dates are not joined.
        """
        return self._stored(self._rows(ITEM_COLUMNS, ORDER_COLUMNS), "items")

    def _rows(self, columns: tuple[str, ...], order_columns: tuple[str, ...]) -> DataFrame:
        orders = self.raw["orders"]
        narrow = orders.select(*[c for c in orders.columns if c in order_columns])
        return master.build_master(self.cleaned | {"orders": clean.clean_orders(narrow)}).select(*columns)

    @cached_property
    def order_facts(self) -> DataFrame:
        """One row per order (persisted): what order-level queries aggregate."""
        from orbitcart.operators.executive import order_facts
        return self._keep(order_facts(self.master))

    @property
    def search_items(self) -> DataFrame:
        """All rows of the master, with the columns that the search's entities are made of; not kept."""
        return self._rows(SEARCH_COLUMNS, (*ORDER_COLUMNS, "order_status"))

    @cached_property
    def item_order_facts(self) -> DataFrame:
        """The order facts of the items, stored: the same rows without the wide master."""
        from orbitcart.operators.executive import order_facts
        return self._stored(order_facts(self.items), "order-facts")

    @cached_property
    def snapshot(self):
        return features.snapshot_date(self.items)

    @cached_property
    def order_features(self) -> DataFrame:
        return features.order_features(self.master)

    @cached_property
    def customer_features(self) -> DataFrame:
        out = self._cut(features.customer_features(self.items, self.snapshot))
        release_shuffles(self.spark)
        return out

    @cached_property
    def feature_store(self) -> DataFrame:
        return self._cut(labels.label_customers(self.customer_features))

    @cached_property
    def product_features(self) -> DataFrame:
        return features.product_features(self.master)

    @cached_property
    def seller_features(self) -> DataFrame:
        return features.seller_features(self.master)

    def table(self, name: str) -> DataFrame:
        return testdata.read_table(self.spark, self.sf_dir, name)


def retail(spark: SparkSession, sf_dir: str) -> Retail:
    key = (id(spark), sf_dir.rstrip("/"))
    r = _MEMO.get(key)
    if r is None or r.spark is not spark:
        r = Retail(spark, sf_dir.rstrip("/"))
        _MEMO[key] = r
    return r
