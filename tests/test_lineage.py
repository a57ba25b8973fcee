from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexiloom.plans import lineage as L
from lexiloom.sources.tables import tasks


def test_written_tables_come_back(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1])], "id bigint, `odd name` string, own array<int>")
    assert rows(L.written(df)) == rows(df) and L.written(df).schema == df.schema
    parted = L.written(df, "id")
    assert rows(parted.where("id = 2").select(*df.columns)) == [(2, None, [1])]
    assert rows(L.written(df.where("id = 9"))) == []


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        with pytest.raises(ValueError):
            L.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_joins_equal_plain_ones(spark, rows, how):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(None, None)], "id bigint, k string")
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3), (None, 4)], "k string, v int")
    want = rows(df.join(side, ["k"], how))
    assert rows(L.spread_join(df, side, ["k"], 10, how)) == want == rows(L.spread_join(df, side, ["k"], 0, how))


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert tasks(df) == 4
    monkeypatch.setattr("lexiloom.sources.tables.TASK_BYTES", 1 << 20)
    assert 4 < tasks(df) < 100 and tasks(L.cut(df.limit(5))) == 4
