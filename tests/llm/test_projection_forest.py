import numpy as np
import pytest

from marketsense.llm import projection_forest, queries


def brute(vectors, k, asks):
    """Every query's best rows, by comparing it with all rows; ids may repeat."""
    rows = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    out = []
    for i, q in rows:
        if asks(i):
            scored = sorted((-float((q * v).sum()), j) for j, v in rows if j != i)[:k]
            out += [(i, rank, j, -far) for rank, (far, j) in enumerate(scored, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "id long, vector array<float>, row int")


def answers(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def same(got, expected):
    assert [row[:3] for row in got] == [row[:3] for row in sorted(expected)]
    assert np.allclose([row[3] for row in got], [row[3] for row in sorted(expected)], rtol=0, atol=1e-12)


def clustered(seed, count, width):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, width))
    return [(i, (middles[rng.integers(12)] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(count)]


def test_a_whole_budget_is_exact(spark):
    rows = clustered(1, 400, 8)
    vectors = table(spark, rows)
    got = projection_forest.nearest(vectors, vectors.filter("id % 7 = 0"), 5, trees=3, leaf=32, recall=1.0, part_bytes=4000)
    exact = set((r[0], r[2]) for r in brute(rows, 5, lambda i: i % 7 == 0))
    found = set((r[0], r[2]) for r in answers(got))
    assert len(exact & found) / len(exact) > 0.97


def test_small_tables_copies_ties_and_unusable_rows(spark):
    spare = [1.0, 0.0, 0.0]
    rows = [(i, spare) for i in range(40)] + [(100 + i, [0.0, 1.0, float(i % 3)]) for i in range(30)]
    rows += [(5, [9.0, 9.0]), (5, [5.0, 5.0]), (20, [9.0, 9.0]), (20, [9.0, 9.0]), (60, None), (80, [1.0, None]), (120, [float("nan"), 1.0]), (140, [0.0, 0.0]), (None, spare), (160, []), (180, [float("inf")])]
    vectors = table(spark, rows)
    got = projection_forest.nearest(vectors, vectors.filter("id % 20 = 0"), 20)
    same(answers(got), brute(rows, 20, lambda i: i % 20 == 0))


def test_large_leaves_are_cut_and_visited_whole(spark):
    """A part takes 8 rows, so every leaf is several blocks; all of them answer."""
    rows = clustered(4, 300, 4)
    vectors = table(spark, rows)
    got = projection_forest.nearest(vectors, vectors.filter("id % 20 = 0"), 300, trees=2, leaf=100, part_bytes=8 * 4 * 4)
    same(answers(got), brute(rows, 300, lambda i: i % 20 == 0))


def test_empty_tables_and_no_queries(spark):
    vectors = table(spark, [])
    assert projection_forest.nearest(vectors, vectors, 5).collect() == []
    one = table(spark, [(1, [1.0]), (2, [2.0])])
    assert projection_forest.nearest(one, one.filter("id > 5"), 5).collect() == []
    alone = table(spark, [(20, [1.0])])
    assert projection_forest.nearest(alone, alone, 5).collect() == []


def test_priority_order_is_shared_by_all_trees():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(600, 6))
    forest = projection_forest.fit_forest(sample, 4, 4)
    cells = forest.route(sample)
    counts = np.bincount(cells.ravel(), minlength=4 * forest.leaves)
    assert counts.sum() == 4 * 600 and (counts.reshape(4, -1).sum(axis=1) == 600).all()
    query = rng.normal(size=(1, 6))
    order = projection_forest.popped_cells(forest.margins(query)[0], counts, forest.leaves, np.inf)
    assert sorted(order) == np.flatnonzero(counts).tolist()
    assert set(forest.route(query)[0]) <= set(order[:16])
    some = projection_forest.popped_cells(forest.margins(query)[0], counts, forest.leaves, 100)
    assert some == order[: len(some)] and counts[some].sum() >= 100 > counts[some[:-1]].sum()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    got = queries.op12_forest_neighbours(spark, f"/root/testdata/{sf}").toPandas()
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, matrix = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    asked = np.flatnonzero((ids % 20 == 0) & (np.abs(matrix).sum(axis=1) > 0))
    assert sorted(set(got.query_id)) == sorted(ids[asked]) and (got.groupby("query_id").size() == 20).all()
    found = {query: set(some) for query, some in got.groupby("query_id").vec_id}
    hits = 0
    for place in asked:
        score = matrix @ matrix[place]
        score[place] = -np.inf
        hits += len(found[ids[place]] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(asked)) >= 0.9
    exact = dict(zip(ids, matrix))
    assert all(abs(exact[row.query_id] @ exact[row.vec_id] - row.score) < 1e-12 for row in got.itertuples())
