"""Every registered query with SQL against DuckDB, and operators on small hand-made tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scalewright.operators import counts as C
from scalewright.plans import registry
from scalewright.sources.responses import from_wide, packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (d[columns].astype(object).where(d[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in columns:
        for x, y in zip(got[c], want[c]):
            assert x == pytest.approx(y, abs=1e-6) if isinstance(x, float) else x == y


def responses(spark, rows):
    return spark.createDataFrame(rows, "person_id long, item_id int, x int")


def test_wide_tables_become_long_and_packed(spark):
    wide = spark.createDataFrame(pd.DataFrame({"who": [1, 2], "a": [1, 0], "b": [0, 1]}))
    long = from_wide(wide, "who", ["a", "b"])
    assert sorted(map(tuple, long.collect())) == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1)]
    assert {r["person_id"]: r["x"] for r in packed(long.where("person_id = 1 or item_id = 0"), 2).collect()} == {1: [1, 0], 2: [0, None]}


def test_binary_validation(spark):
    C.require_binary(responses(spark, [(1, 0, 1), (1, 1, 0)]))
    with pytest.raises(ValueError):
        C.require_binary(responses(spark, [(1, 0, 2)]))
    with pytest.raises(ValueError):
        C.require_binary(responses(spark, [(1, 0, None)]))
    C.require_binary(responses(spark, [(1, 0, None)]), allow_missing=True)


def test_bands_never_split_equal_scores_and_reach_the_target(spark):
    rows = [(p, j, int(j < p % 4)) for p in range(40) for j in range(3)]
    bands = {r["score"]: r["band"] for r in C.value_bands(responses(spark, rows), 3).collect()}
    assert bands == {0.0: 0, 0.333333333: 1, 0.666666667: 2, 1.0: 3}
    # 10, 10 and 1 persons with a target of 10: two bands, and the thin tail joins the second.
    few = [(p, j, int(j < (3 if p == 0 else p % 2))) for p in range(21) for j in range(3)]
    assert {r["score"]: r["band"] for r in C.value_bands(responses(spark, few), 3).collect()} == {0.0: 0, 0.333333333: 1, 1.0: 1}


def test_holm_by_hand(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: round(r["adjusted"], 9) for r in C.holm(p).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_empty_responses_give_empty_tables(spark):
    none = responses(spark, [])
    assert C.item_facility(none).collect() == [] and C.score_groups(none, 3).collect() == [] and C.prepare_checks(none, 3).collect() == []


def test_bands_keep_persons_with_missing_answers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, j, None if rng.random() < 0.2 else int(rng.random() < 0.3 + 0.1 * j)) for i in range(300) for j in range(4)]
    rows += [(900, j, None) for j in range(4)]
    r = spark.createDataFrame(rows, "person_id long, item_id int, x int")
    for order in ("facility", "adjusted"):
        cells = C.prepare_bands(r, 4, order, 20).collect()
        assert sum(c["n_total"] for c in cells) == sum(x is not None for _, _, x in rows)
        assert sum(c["n_right"] for c in cells) == sum(x or 0 for _, _, x in rows)
        ability = {c["band"]: c["ability"] for c in cells}
        assert len(ability) >= 3 and [ability[k] for k in sorted(ability)] == sorted(ability.values())
        assert {c["item_id"]: c["facility_rank"] for c in cells} == {0: 1, 1: 2, 2: 3, 3: 4}
    with pytest.raises(ValueError):
        C.prepare_bands(r, 4, "complete")
    assert C.prepare_bands(r.where("false"), 4).count() == 0


def test_validation_tells_kinds_apart(spark):
    frame = lambda rows: spark.createDataFrame([(i, j, x) for i, row in enumerate(rows) for j, x in enumerate(row)], "person_id long, item_id int, x int")
    assert C.require_valid(frame([[0, 1], [1, 0]])) == "binary" and C.require_valid(frame([[0, 2], [1, 0], [0, 1]])) == "graded"
    assert C.require_valid(frame([[None, 1], [1, 0]]), allow_missing=True) == "binary"
    for bad in ([[None, 1]], [[-1, 0]], [[0, 3], [1, 0]], [[None, None]], [[2, 2], [2, 1]]):
        with pytest.raises(ValueError):
            C.require_valid(frame(bad))
