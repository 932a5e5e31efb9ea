"""Cells: the number of tasks follows the files, and the rows stay the same."""

from fovea import runtime
from fovea.sources import binding


def test_cells_are_joined_in_tasks_of_bounded_files(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(r.cell_id for r in binding.cells(spark, sf).collect())
    monkeypatch.setattr(runtime, "TASK_BYTES", 1 << 10)
    tasks = runtime.source_tasks(spark, f"{sf}/lineitem.parquet")
    assert tasks > spark.sparkContext.defaultParallelism
    dealt = binding.cells(spark, sf)
    assert dealt.rdd.getNumPartitions() == tasks
    assert sorted(r.cell_id for r in dealt.collect()) == whole
