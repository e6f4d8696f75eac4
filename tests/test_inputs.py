"""Given tables, dealt to tasks by their rows."""

from checks.derived import DEALT, Inputs


def test_rows_of_a_task(spark, tmp_path):
    """However few cores are registered when the plan is built, no task gets many more rows than the bound."""
    key, rows = DEALT["pages"]
    n = rows * (3 * spark.sparkContext.defaultParallelism)
    spark.range(n).toDF(key).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    table = Inputs(spark, str(tmp_path)).given("pages")
    sizes = table.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == n and table.distinct().count() == n
    assert max(sizes) < 1.5 * rows


def test_small_tables_keep_every_core_busy(spark, tmp_path):
    spark.range(10).toDF("page_id").write.parquet(f"{tmp_path}/pages.parquet")
    table = Inputs(spark, str(tmp_path)).given("pages")
    assert table.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and table.count() == 10
