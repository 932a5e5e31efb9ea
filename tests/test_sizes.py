"""Content keys: the number of tasks follows the rows, and the rows stay the same."""

from fovea.sources import load


def keys_of(df):
    return sorted(r.cell_id for r in df.collect())


def test_content_keys_are_grouped_in_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i // 5, i % 3) for i in range(200)], "k long, v long").coalesce(1)
    whole = keys_of(load.with_cell_key(df, "k"))
    monkeypatch.setattr(load, "ROWS_PER_TASK", 10)
    dealt = load.with_cell_key(df, "k")
    assert dealt.rdd.getNumPartitions() == 20
    assert keys_of(dealt) == whole and len(set(whole)) == 200


def test_copies_beyond_one_task_are_counted_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(load, "ROWS_PER_TASK", 10)
    keys = keys_of(load.with_cell_key(spark.createDataFrame([(1, 2)] * 50 + [(None, 2)], "k long, v long"), "k"))
    assert len(set(keys)) == 51
