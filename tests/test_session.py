import os

from logloom import session


def test_folders_are_forgotten(spark):
    made = session.new_folder(spark, "x")
    spark.range(3).write.parquet(made)
    assert os.path.isdir(made.removeprefix("file:")) and session.new_folder(spark, "x") != made
    assert session.forget_folders() >= 1 and not os.path.exists(made.removeprefix("file:"))
    assert session.forget_folders() == 0
