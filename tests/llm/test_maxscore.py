import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketsense.llm import maxscore, queries

SCHEMA = "id long, vector array<long>"


def brute(rows, queries, k):
    for own, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != own)
        for rank, (score, i) in enumerate(scores[:k], 1):
            yield own, rank, i, -score


@pytest.mark.parametrize("shard", [16, 1000])
@pytest.mark.parametrize("scale", [3, 200, 2**28])
def test_equals_brute_force(spark, shard, scale):
    rng = np.random.default_rng(scale)
    rows = [(i, rng.integers(-scale, scale, 12).tolist()) for i in range(300)] + [(400 + i, [1] * 12) for i in range(40)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    asking = [r for r in rows if r[0] % 20 == 0]
    got = maxscore.top_k(vectors, spark.createDataFrame(asking, SCHEMA), 5, shard=shard, block=7).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, asking, 5))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert maxscore.top_k(empty, empty, 5).collect() == []
    rows = [(0, [1, 2]), (0, [1, 2]), (1, [3]), (2, []), (3, None), (None, [5, 5]), (4, [1, 2, 9])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = maxscore.top_k(vectors, vectors.filter("id = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(2 * [(0, 1, 4, 5), (0, 2, 1, 3), (0, 3, 2, 0)])


def test_repeated_ids_all_ask_and_answer(spark, tmp_path):
    """Rows of one id are candidates and queries of their own; the registered SQL agrees."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 60)), rng.normal(size=4).round(1).tolist()) for _ in range(200)] + [(1, [9.0] * 4), (1, [5.0] * 4), (50, [1.0] * 4), (50, [-1.0] * 4), (None, [1.0] * 4)]
    rows += [(7, None), (7, [1.0, None, 1.0, 1.0]), (7, [float("nan")] * 4)] + [(1, [9.0] * 4)] * 3
    path = str(tmp_path / "sf")
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op2_maxscore_search(spark, path).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    assert got == sorted((q, int(r), v, s) for q, r, v, s in con.execute(f"select query_id, rank, vec_id, score from ({queries.ORACLES['op2_maxscore_search']})").fetchall())
    assert sum(query == 50 for query, *_ in got) == 5 * sum(i == 50 for i, _ in rows)


def test_shards_and_blocks_move_once_per_lane(spark):
    vectors = spark.createDataFrame([(i, [i % 7, 1]) for i in range(400)], SCHEMA)
    found = maxscore.top_k(vectors, vectors.filter("id % 20 = 0"), 3, shard=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan


def test_quantised(spark):
    rows = [([0.5, -0.001],), (None,), ([None, 1.0],), ([float("nan")],), ([float("inf")],), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(maxscore.quantised(F.col("v")).alias("q")).collect()
    assert [r.q for r in got] == [[128, -1], None, None, None, None, []]
