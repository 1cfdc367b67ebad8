import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from voxtally import session
from voxtally.sources.sink import write_csv


def fake(setting, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting),
                           sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_dir():
    assert session.shared_dir(fake("hdfs:///scratch/", "yarn")) == "hdfs:///scratch"
    local = session.shared_dir(fake(None, "local[4]"))
    assert local == session.shared_dir(fake(None, "local[4]"))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake(None, "yarn"))


def test_bounded_rows(spark):
    assert session.bounded_rows(spark.range(3), 2) is None
    assert len(session.bounded_rows(spark.range(3), 3)) == 3


def test_stage_is_written_once(spark):
    staged = session.stage(spark.range(100).withColumn("r", F.rand()))
    assert staged.collect() == staged.collect()
    assert len(staged.inputFiles()) > 0


def test_write_falls_back(spark, tmp_path, monkeypatch):
    (tmp_path / "out").write_text("a file in the way")
    plain, calls = DataFrameWriter.csv, []

    def csv(self, path, *args, **kwargs):
        calls.append(path)
        return plain(self, path if len(calls) == 1 else f"{tmp_path}/beside", *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "csv", csv)
    path = write_csv(spark.range(3), f"{tmp_path}/out", "t.csv")
    assert len(calls) == 2 and path == calls[1] != calls[0]
    assert spark.read.option("header", True).csv(f"{tmp_path}/beside").count() == 3


def test_a_failing_query_is_not_run_again(spark, tmp_path, monkeypatch):
    plain, calls = DataFrameWriter.csv, []

    def csv(self, path, *args, **kwargs):
        calls.append(path)
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "csv", csv)
    with pytest.raises(Exception):
        write_csv(spark.range(3).select(F.raise_error(F.lit("no"))), str(tmp_path), "t.csv")
    assert len(calls) == 1


def test_scratch_is_removed(spark):
    with session.scratch(spark):
        path = session.stage(spark.range(5)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    outside = session.stage(spark.range(5))
    assert outside.count() == 5
