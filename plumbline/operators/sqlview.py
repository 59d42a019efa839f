"""SQL over registered tables: the caller's text goes to Spark SQL as it is."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Plan nodes that change something: commands, and statements not yet bound to a table (such as INSERT).
WRITERS = (LOGICAL + "Command", LOGICAL + "ParsedStatement")


def _only_reads(spark: SparkSession, text: str) -> bool:
    """Whether Spark's own parser finds a query and nothing that writes, also not below WITH."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(name) for name in WRITERS]
    nodes = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while nodes:
        node = nodes.pop()
        if any(kind.isInstance(node) for kind in kinds):
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        inner = node.innerChildren()
        nodes += [x for x in (inner.apply(i) for i in range(inner.size())) if jvm.java.lang.Class.forName(LOGICAL + "LogicalPlan").isInstance(x)]
    return True


def run_sql(sql: str, **tables: DataFrame) -> DataFrame:
    """Run one SELECT / WITH query with each table visible under its keyword name.

    Anything else raises. The names are bound while the query is analyzed; temporary views of the same names come back.
    """
    if not tables:
        raise ValueError("at least one table is needed")
    text = sql
    for mark in ("```sql", "```"):
        text = text.replace(mark, "")
    text = text.strip().rstrip(";").strip()
    spark = next(iter(tables.values())).sparkSession
    try:
        reads = _only_reads(spark, text)
    except ParseException as error:
        raise ValueError(f"not one query: {error}") from error
    if not reads:
        raise ValueError("only SELECT and WITH queries are run")
    views = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
            if name in views:
                views[name].createOrReplaceTempView(name)
