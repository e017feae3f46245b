"""How operators are bound to the tables at hand, in Spark and in the same words in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Plans:
    """Queries and their SQL under one name. ``shared`` holds common table expressions that all SQL here may use."""

    def __init__(self, shared: str = ""):
        self.shared = shared.strip()
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = f"WITH {self.shared} {sql}" if self.shared and "WITH RECURSIVE" not in sql else sql.replace("/*shared*/", self.shared)
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
