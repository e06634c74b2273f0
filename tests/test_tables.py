from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stacklore.functions import tables
from stacklore import storage
from stacklore.storage import cut, shared_dir


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_dictionary_join_equals_a_plain_join(spark, hot):
    rows = [("a", i, "x") for i in range(500)] + [("b", i, "y") for i in range(20)] + [("c", 1, "z"), ("none", 1, "z")]
    big = spark.createDataFrame(rows, "k string, n int, rank string")
    words = spark.createDataFrame([("a", 500, 1), ("b", 20, 2), ("c", 1, 3), ("unused", 9, 4)], "k string, uses int, v int")
    got = tables.dictionary_join(big, words, ["k"], ["v"], "uses", hot)
    assert got.columns == ["k", "n", "rank", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(words, "k").select("k", "n", "rank", "v").collect()))
    assert tables.dictionary_join(big.limit(0), words, ["k"], ["v"], "uses", hot).count() == 0


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_semi_join_by_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "BROADCAST_IDS", bound)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id bigint, x string")
    got = tables.semi_by_ids(rows, spark.createDataFrame([(2,), (2,), (7,)], "id bigint"), "id")
    assert sorted(r["x"] for r in got.collect()) == ["b", "c"]


def test_current_rows(spark):
    old, new = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [("a", 1, new, "x", ["t"]), ("a", 2, old, "y", None), ("b", 3, None, "z", []), ("b", 4, None, None, None), ("c", 5, None, "u", None), ("c", 6, old, "v", None), (None, 9, new, "w", None), ("d", 7, new, "p", None), ("d", 8, new, "q", None)]
    df = spark.createDataFrame(rows, "name string, row_id bigint, collected_at timestamp, newest string, topics array<string>")
    got = {r["name"]: (r["row_id"], r["newest"]) for r in tables.current_rows(df, "newest", "topics").collect()}
    assert got == {"a": (1, "x"), "b": (4, None), "c": (6, "v"), "d": (8, "q")}


def test_folded(spark):
    df = spark.createDataFrame([([" A\t", "\xa0a", None, "", " \xa0", "B c"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(tables.folded_set(F.col("x"))).collect()] == [["a", "b c"], [], []]


def test_cut_keeps_rows_and_names(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "id int, items array<string>, n bigint")
    got = cut(df)
    assert got.dtypes == df.dtypes and got.collect() == df.collect()
    assert cut(df.limit(0)).count() == 0
    assert shared_dir(spark)


class Cluster:
    """A session whose executors are elsewhere, or have folders of their own."""

    def __init__(self, folder, rows):
        self.sparkContext = self.conf = self
        self.master, self.applicationId, self.folder, self.rows = "spark://host:7077", "app", folder, rows
        self.read = self.write = self

    def get(self, key, default=None):
        return self.folder

    def getConf(self):
        return self

    def range(self, *_):
        return self

    def parquet(self, path):
        return self

    def schema(self, text):
        return self

    def count(self):
        return self.rows


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster(None, 64))
    with pytest.raises(ValueError, match="not shared: 10 of 64"):
        shared_dir(Cluster("file:///own", 10))
    assert shared_dir(Cluster("hdfs://shared/", 64)) == "hdfs://shared"


def test_tables_are_removed(spark):
    from pathlib import Path

    def there(df):
        return Path(df._stacklore_table.removeprefix("file://")).exists()

    kept = cut(spark.range(3))
    with storage.tables():
        inner = cut(spark.range(3))
        assert there(inner)
    assert there(kept) and not there(inner)
    storage.drop(kept)
    storage.drop(None)
    storage.drop(spark.range(1))
    assert not there(kept)
