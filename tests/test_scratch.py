from __future__ import annotations

import os

from tallgrass import scratch


def test_tables_go_to_the_shared_folder_and_away(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.shared_dir(spark).startswith(root)
    df = scratch.materialize(spark.range(5).withColumnRenamed("id", "a b"), "t")
    assert sorted(r[0] for r in df.collect()) == list(range(5)) and "ExistingRDD" not in df._jdf.queryExecution().toString()
    empty = scratch.materialize(spark.range(0), "t")
    assert empty.count() == 0
    folder = scratch.new_path(spark, "x").removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
