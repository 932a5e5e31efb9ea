"""Stage results follow the state of the tables they come from."""

import time

from fovea import runtime


def test_a_table_folder_written_anew_makes_a_stage_anew(spark, tmp_path):
    folder = str(tmp_path / "tables")
    read = lambda: runtime.staged(spark, "sum", folder, lambda: spark.read.parquet(f"{folder}/t.parquet").groupBy().sum("id")).first()[0]
    spark.range(10).repartition(2).write.parquet(f"{folder}/t.parquet")
    assert read() == 45
    assert read() == 45
    time.sleep(0.01)
    spark.range(20).repartition(2).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert read() == 190
    spark.range(20, 21).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    assert read() == 210
