import os

from plumbline.sources.scratch import scope, scratch_path, scratch_table


def test_scope_removes_what_was_made_inside(spark):
    outside = scratch_path(spark, "kept")
    spark.range(3).write.parquet(outside)
    with scope() as made:
        inside = scratch_path(spark, "gone")
        spark.range(3).write.parquet(inside)
        table = scratch_table(spark, "gone")
        spark.range(3).write.bucketBy(2, "id").option("path", scratch_path(spark, "bucketed")).saveAsTable(table)
    assert made.feeds(spark.read.parquet(inside)) and made.feeds(spark.table(table)) and not made.feeds(spark.read.parquet(outside))
    bucketed = made.paths[1]
    made.remove(spark)
    made.remove(spark)
    assert os.path.exists(outside) and not os.path.exists(inside) and not os.path.exists(bucketed)
    assert not spark.catalog.tableExists(table)
