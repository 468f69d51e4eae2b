import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import pivots, vector


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    centers = r.normal(0, 10, (30, 16))
    x = centers[r.integers(0, 30, 3000)] + r.normal(0, 1, (3000, 16))
    x[5] = x[4] = x[3]
    rows = [(i, [float(v) for v in x[i]] if i % 50 else None, f"t{i % 3}") for i in range(3000)]
    return spark.createDataFrame(rows, "rowid long, embedding array<float>, type string")


def ranked(df):
    return sorted(map(tuple, df.collect()))


def test_same_rows_as_the_full_scan_with_few_vectors_read(spark, clustered, tmp_path):
    index = pivots.write_pivots(clustered, str(tmp_path / "v"))
    q = clustered.where("rowid % 41 = 3").select(F.col("rowid").alias("qid"), "embedding")
    for k, allowed in ((1, None), (5, None), (5, F.col("type") == "t1"), (200, F.col("rowid") < 300)):
        report = {}
        got, want = ranked(pivots.search_pivots(q, index, k, allowed, report)), ranked(vector.search_l2(q, clustered, k, allowed))
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.abs(np.array([x[3] for x in got]) - np.array([x[3] for x in want])).max() < 3e-6
        if allowed is None:
            assert report["share"] < 0.2
    plan = index.vectors().where(F.col("pivot").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pivot" in plan or "PartitionFilters: [pivot" in plan


def test_no_vectors_and_no_queries(spark, clustered, tmp_path):
    index = pivots.write_pivots(clustered.where("embedding is null"), str(tmp_path / "none"))
    q = clustered.where("rowid = 3").select(F.col("rowid").alias("qid"), "embedding")
    assert pivots.search_pivots(q, index).collect() == []
    some = pivots.write_pivots(clustered.limit(3), str(tmp_path / "few"))
    assert pivots.search_pivots(q.limit(0), some).collect() == []
    assert ranked(pivots.search_pivots(q, some, 5)) == ranked(vector.search_l2(q, clustered.limit(3), 5))
