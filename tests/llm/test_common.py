from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmill.llm import common


def session(master, conf=(), checkpoint=None):
    conf = dict(conf)
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


def test_scratch_tables_lie_in_a_shared_folder():
    assert common.scratch(session("spark://x:7077", {"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert common.scratch(session("yarn", checkpoint="hdfs://c")) == "hdfs://c"
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            common.scratch(session(master))
    own = session("local[4]")
    assert common.scratch(own) == common.scratch(own)


def test_functions_get_slices(spark, monkeypatch):
    sizes = spark.range(1_701).coalesce(1).select(common.map_column(lambda a: pa.array([len(a)] * len(a), pa.int64()), "bigint", F.col("id")).alias("n"))
    assert sorted({r.n for r in sizes.collect()}) == [1_701 % common.ROWS, common.ROWS]
    assert sizes.where("n < 0").count() == 0 and sizes.limit(0).collect() == []
    batches = list(common.slices_of(iter([pa.RecordBatch.from_pydict({"a": list(range(1_200))}), pa.RecordBatch.from_pydict({"a": []})])))
    assert [b.num_rows for b in batches] == [500, 500, 200] and batches[2].column(0)[0].as_py() == 1_000


def test_names_that_clash_with_nothing(spark):
    assert common.unused(spark.createDataFrame([], "a int, A_ int, b int"), "a") == "a__"
