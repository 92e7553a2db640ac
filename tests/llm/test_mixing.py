import pytest
from pyspark.sql import functions as F

from marketsense.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, Target string"


def mixed(spark, rows, **options):
    return mixing.mix_sources(spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA), **options).collect()


def test_each_source_gives_its_budget_exactly(spark):
    rows = [(i, "w " * (i % 23), f"s{min(i % 11, 4)}") for i in range(900)] + [(1000 + i, "v " * 9, None) for i in range(40)]
    got = mixed(spark, rows)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(r[0].target for r in by_source.values()) == pytest.approx(1.5 * total)
    for found in by_source.values():
        assert sum(r.size for r in found) == found[0].source_size
        assert sum(r.taken for r in found) == int(found[0].target) <= 2 * found[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in found)
        # Starts are the running sums of some order.
        place = 0
        for r in sorted(found, key=lambda r: (r.start, r.start + r.size)):
            assert r.start == place
            place += r.size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(spark, rows[::-1])))


def test_weights_follow_code_points_and_caps_reshare(spark):
    rows = [(0, "a " * 100, "Z"), (1, "a " * 100, "a"), (2, "a " * 100, "é"), (3, "a " * 1000, None)]
    # Weights 3, 1, 2, 3 over 1950 words: Z 200 (capped), a and é below, null takes up the rest.
    targets = {r.source: r.target for r in mixed(spark, rows)}
    assert targets == {"Z": 200.0, "a": 200.0, "é": 200.0, None: 1350.0}


def test_edge_cases(spark):
    assert mixed(spark, []) == []
    rows = [(1, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (2, "", None), (3, " \t", "b"), (4, "w " * 50000, "a")]
    got = mixed(spark, rows)
    assert sum(r.taken for r in got) == int(sum({r.source: r.target for r in got}.values()))
    assert {r.source: r.target for r in got}["b"] == 0.0
    assert all(r.taken == 0 for r in got if r.size == 0)


def test_repeated_keeps_columns_and_counts(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA)
    mix = mixing.mix_sources(docs, weights=(1, 3))
    got = mixing.repeated(docs, mix)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    for r in mix.collect():
        assert abs(counts.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2
    assert mixing.repeated(docs.limit(0), mix).filter(F.lit(True)).collect() == []


def test_rows_that_repeat_an_id_are_taken_on_their_own(spark):
    """A document that is not taken is not repeated because another row of its id is."""
    rows = [(i % 40, "w " * (1 + i % 7) + str(i), "ab"[i % 2]) for i in range(300)] + [(None, "x y z", "a"), (5, None, "a"), (5, "one two", None)]
    docs = spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA)
    mix = mixing.mix_sources(docs, weights=(1, 3))
    want = {}
    for r in mix.collect():
        copies = (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
        want[(r.doc_id, r.size)] = want.get((r.doc_id, r.size), 0) + copies
    got = {}
    for r in mixing.repeated(docs, mix).collect():
        key = (r.doc_id, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    # Rows with equal id and size at a cut are taken alike; all others agree exactly.
    differ = {key for key in want if want[key] != got.get(key, 0)}
    assert len(differ) <= 2 and set(got) <= set(want)
    plan = mixing.repeated(docs, mix)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 8
