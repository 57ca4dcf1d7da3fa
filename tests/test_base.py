"""Response tables and fixed models at their edges."""

import math

import pytest

from scalewright.operators import counts as C
from scalewright.sources import responses
from scalewright.sources.responses import packed


def test_repeated_answers_are_folded(spark):
    r = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 1, None), (1, 2, 1), (2, 1, 0), (2, 1, 0)], "person_id long, item_id int, x int")
    assert {x["person_id"]: x["x"] for x in packed(r, 3).collect()} == {1: [1, None, 1], 2: [None, 0, None]}


def test_certain_probabilities_keep_a_likelihood(spark):
    p = spark.createDataFrame([(1, [1, 0]), (2, [0, None])], "person_id long, x array<int>")
    rows = {r["person_id"]: r for r in C.posteriors(p, [0.5, 0.5], [[1.0, 0.0], [0.5, 0.5]]).collect()}
    assert rows[1]["loglik"] == pytest.approx(math.log(0.5 * 1 + 0.5 * 0.25), abs=1e-6)
    assert rows[2]["post"][0] == pytest.approx(1e-10 / (1e-10 + 0.5), rel=1e-6)


def test_mask_ranks_over_groups_of_ids(spark):
    r = spark.createDataFrame([(p, j, None if p % 9 == 0 else (p * 7 + j) % 2) for p in range(100) for j in range(3)], "person_id long, item_id int, x int")
    rows = C.mask_ranks(r, 3, ids_per_group=8).collect()
    means = {}
    for x in r.collect():
        means.setdefault(x["person_id"], []).append(x["x"])
    mean = {k: None if v[0] is None else sum(v) / 3 for k, v in means.items()}
    order = sorted(mean, key=lambda k: (mean[k] is None, mean[k] or 0, k))
    assert {x["person_id"]: x["rank"] for x in rows} == {k: i + 1 for i, k in enumerate(order)}


def test_workers_of_an_older_session_find_the_package(spark):
    import os

    import __spark_entry__ as entry

    before = dict(spark.sparkContext.environment)
    try:
        spark.sparkContext.environment.pop("PYTHONPATH", None)
        entry.ship(spark)
        entry.ship(spark)
        assert spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep).count(entry.ROOT) == 1
        assert len(spark.range(3).mapInPandas(lambda batches: batches, "id long").collect()) == 3
    finally:
        spark.sparkContext.environment.clear()
        spark.sparkContext.environment.update(before)


def test_keys_are_dealt_to_tasks_of_their_own(spark):
    import pandas as pd
    from pyspark import TaskContext

    from scalewright.operators.fanout import per_key

    def where(group):
        return pd.DataFrame({"rep": [int(group["rep"].iloc[0])], "task": [TaskContext.get().partitionId()], "n": [len(group)]})

    df = spark.range(600).selectExpr("cast(id % 12 - 1 as int) as rep", "id")
    rows = per_key(df, "rep", 12, where, "rep int, task int, n int").collect()
    assert sorted(r["rep"] for r in rows) == list(range(-1, 11)) and len({r["task"] for r in rows}) == 12 and {r["n"] for r in rows} == {50}


def test_lines_and_orders_are_not_sorted(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = responses.from_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_packing_few_and_many_items(spark):
    rows = [(1, 0, 1), (1, 0, 2), (1, 2, 0), (2, 5, None), (2, 1, 3), (3, 70, 4), (None, 1, 1), (4, 0, None), (None, 1, 2), (5, None, 1)]
    df = spark.createDataFrame(rows, "person_id long, item_id int, x int").where("item_id is not null")
    few, many = (responses.packed(df, n).collect() for n in (3, 33))
    assert responses.ITEMS_AT_ONCE < 33
    expected = {1: [2, None, 0], 2: [None, 3, None], 3: [None] * 3, None: [None, 2, None]}
    assert {r["person_id"]: r["x"] for r in few} == expected and len(few) == len(many) == 4
    assert {r["person_id"]: r["x"][:3] for r in many} == expected
