"""Builds, versions, tampering and the locked split."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versions import Dataset


def _bars(spark, days, close=1.0, symbols=("A", "B")):
    d = datetime.date(1998, 12, 1)
    return spark.createDataFrame([(s, d + datetime.timedelta(k), close + k) for s in symbols for k in days], "symbol string, time date, close double")


@pytest.fixture
def dataset(spark, tmp_path):
    return Dataset(spark, f"file://{tmp_path}", "bars")


def test_versions_accumulate(spark, dataset):
    assert dataset.versions() == []
    with pytest.raises(LookupError):
        dataset.resolve()
    assert dataset.build(_bars(spark, range(40))) == 1
    assert dataset.build(_bars(spark, range(30, 60), close=500.0), accumulate=True) == 2
    assert dataset.build(_bars(spark, range(5))) == 3 and dataset.versions() == [1, 2, 3]
    two = {(x.symbol, x.time): x.close for x in dataset.load(2, allow_test=True).collect()}
    assert len(two) == 120 and two["A", datetime.date(1998, 12, 1)] == 1.0 and two["A", datetime.date(1998, 12, 31)] == 530.0  # new rows win
    assert dataset.load(1, allow_test=True).count() == 80 and dataset.load(split="train").count() == 10
    with pytest.raises(ValueError):
        dataset.build(_bars(spark, []))
    assert dataset.versions() == [1, 2, 3]


def test_splits_and_the_ledger(spark, dataset):
    dataset.build(_bars(spark, [0, 30, 31, 577, 578, 900]))
    assert [dataset.load(split=s).count() for s in ("train", "validation", "train+validation")] == [4, 4, 8]
    for split in (None, "test", "train+test"):
        with pytest.raises(PermissionError):
            dataset.load(split=split)
    with pytest.raises(ValueError):
        dataset.load(split="dev")
    assert dataset.ledger().count() == 0
    assert dataset.load(split="test", allow_test=True, note="final grade").count() == 4
    dataset.load(allow_test=True, note="look")
    assert [(x.split, x.note, x.version) for x in dataset.ledger().orderBy("note").collect()] == [("test", "final grade", "v1"), ("train+validation+test", "look", "v1")]


def test_tampering_shows(spark, dataset, tmp_path):
    dataset.build(_bars(spark, range(40)))
    assert {x.status for x in dataset.verify().collect()} == {"ok"}
    a, b = (sorted((tmp_path / f"bars/v1/bars/symbol={s}").glob("*.parquet"))[0] for s in "AB")
    (a.parent / f".{a.name}.crc").unlink()  # as one who tampers would
    a.write_bytes(a.read_bytes()[:-1] + b"x")
    b.rename(b.parent / f"copy-{b.name}")
    got = {x.file.rsplit("/", 1)[-1]: x.status for x in dataset.verify().where(F.col("status") != "ok").collect()}
    assert got == {a.name: "changed", b.name: "missing", f"copy-{b.name}": "added"}
