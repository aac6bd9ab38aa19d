"""Versioned tables: old or new, never a mix."""

import pytest
from pyspark.sql import functions as F

from parcelspark.sources.tables import Conflict, Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "s")
    with pytest.raises(FileNotFoundError):
        t.read()
    make = lambda data: spark.createDataFrame(data, "k int, v string, s string")
    assert t.replace(make([(1, "a", "x"), (2, "b", "y/ =z"), (3, "c", None)])) == 1
    assert t.replace(make([(4, "d", "x"), (5, "e", "x")])) == 2
    assert rows(t.read()) == [(2, "b", "y/ =z"), (3, "c", None), (4, "d", "x"), (5, "e", "x")] and rows(t.read(1)) == [(1, "a", "x"), (2, "b", "y/ =z"), (3, "c", None)]
    # a job that fails, before its rows are written or after, changes nothing
    with pytest.raises(Exception):  # noqa: B017
        t.replace(make([(9, "z", "x")]).withColumn("v", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(ValueError):
        t.replace(make([]))
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.replace(make([(9, "z", "x")]))
    t._publish = publish
    assert t.version() == 2 and (4, "d", "x") in rows(t.read())
    # a batch made from an older version does not overwrite a newer one
    with pytest.raises(Conflict):
        t.replace(make([(9, "z", "x")]), on=1)
    assert t.upsert(make([(4, "d2", "x"), (4, "d1", "x"), (6, "f", "x"), (7, "n", None)]), ["k"], ["v"]) == 3
    assert rows(t.read()) == [(2, "b", "y/ =z"), (3, "c", None), (4, "d2", "x"), (5, "e", "x"), (6, "f", "x"), (7, "n", None)]
    assert t.upsert(make([(4, "d3", "x"), (8, "g", "w")]), ["k"], ["v"], mode="ignore") == 4
    assert (4, "d2", "x") in rows(t.read()) and (8, "g", "w") in rows(t.read())
    held = t.read()
    t.vacuum(keep=2)
    assert rows(t.read()) == rows(held) and t.version() == 4 and len(list((tmp_path / "t" / "data").iterdir())) <= 5
    with pytest.raises(Exception):  # noqa: B017
        t.manifest(1)


def test_first_version_by_upsert(spark, tmp_path):
    t = Table(spark, str(tmp_path / "u"), "s")
    batch = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", "y")], "k int, v string, s string")
    assert t.upsert(batch, ["k"], ["v"]) == 1 and rows(t.read()) == [(1, "b", "x"), (2, "c", "y")]
