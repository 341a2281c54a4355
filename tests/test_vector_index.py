import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import embedding, vector_index
from blockloom.workspace import own_path

SCHEMA = "id long, embedding array<double>"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


def clustered(n, dim=8, centres=12, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    own = rng.integers(0, centres, n)
    return (c[own] + spread * rng.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_index_gives_what_search_gives(spark, spread, monkeypatch):
    for name, value in (("PROBE", 40), ("SHARD", 50), ("BLOCK", 7)):
        monkeypatch.setattr(vector_index, name, value)
    vecs = clustered(900, spread=spread)
    vecs[100:400] = [vecs[0]] * 300  # a third are copies
    vecs[5] = [0.0] * 8
    df = spark.createDataFrame(list(enumerate(vecs)), SCHEMA).repartition(5)
    q = spark.createDataFrame([(i, vecs[i]) for i in range(0, 900, 9)] + [(5, vecs[5]), (10**6, [1.0] * 9), (None, vecs[1]), (10**6 + 1, [float("nan")] * 8), (10**6 + 2, None)], "query_id long, embedding array<double>")
    index = vector_index.create(df, own_path(spark), pivots=12)
    want = rows_of(embedding.search(df, q.where("query_id < 1000"), 6))
    assert rows_of(vector_index.search(index, q, 6)) == want
    assert rows_of(vector_index.search(vector_index.load(spark, index.path), q, 6)) == want
    seen = vector_index.pruning(index, q.where("query_id > 5 and query_id < 1000"), 6).agg(F.sum("rows_asked"), F.sum("rows")).first()
    assert seen[0] < 0.6 * seen[1] if spread < 1 else seen[0] <= seen[1]
    assert vector_index.search(index, q.limit(0), 6).count() == 0


def test_batches_keep_their_bounds(spark, tmp_path):
    vecs = clustered(300)
    df = spark.createDataFrame(list(enumerate(vecs)), SCHEMA)
    index = vector_index.create(df.where("id < 200"), own_path(spark), pivots=6)
    assert vector_index.append(index, df.where("id >= 200"), "late")
    assert not vector_index.append(index, df.where("id >= 200"), "late")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    assert rows_of(vector_index.search(index, q, 4)) == rows_of(embedding.search(df, q, 4))
    with pytest.raises(ValueError):
        vector_index.append(index, spark.createDataFrame([(1, [1.0])], SCHEMA), "short")
    # a batch whose bounds were not written is not there
    index.spark.read.parquet(f"{index.path}/rows/batch=late").write.partitionBy("pivot").parquet(f"{index.path}/rows/batch=torn")
    assert rows_of(vector_index.search(index, q, 4)) == rows_of(embedding.search(df, q, 4))
    odd = spark.createDataFrame([(None, vecs[0]), (901, None), (902, [None] * 8), (903, [float("inf")] * 8)], SCHEMA)
    assert vector_index.append(index, odd, "odd") and index.bounds().agg(F.sum("n")).first()[0] == 300
    with pytest.raises(ValueError):
        vector_index.create(df.limit(0), own_path(spark))
    # an empty index in all but its first batch; one row only
    one = vector_index.create(df.limit(1), own_path(spark))
    assert vector_index.search(one, q, 4).count() == q.count()
