"""Named queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.sources.views import table, view

Plan = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t("orders")`` reads a table, ``t.view("dirty_orders")`` a derived view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan

    return register


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 digits: summation order differs between engines and runs."""
    return df.select(
        *[
            (F.round(col(f.name), digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)).alias(
                f.name
            )
            for f in df.schema
        ]
    )


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir.rstrip("/")))
