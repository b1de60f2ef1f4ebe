"""The driver tables, and the wide views the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The same DataFrame each time, so its columns can be named in joins."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def sales(self) -> DataFrame:
        """Orders widened by customer, nation and region: one analysis table."""
        return (
            self.orders.join(self.customer, self.orders["o_custkey"] == self.customer["c_custkey"])
            .join(self.nation, self.customer["c_nationkey"] == self.nation["n_nationkey"])
            .join(self.region, self.nation["n_regionkey"] == self.region["r_regionkey"])
        )

    def items(self) -> DataFrame:
        """Order lines widened by their part."""
        return self.lineitem.join(self.part, self.lineitem["l_partkey"] == self.part["p_partkey"])


SALES_SQL = """SELECT * FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""
