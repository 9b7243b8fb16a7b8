"""Ticks repeated at later times, dealt over files otherwise each time: windows of equal bars are equally near."""

import duckdb
import pytest
from conftest import DATA

from tapeline.operators import bars
from tapeline.plans.catalogue import QUERIES
from tapeline.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Nine times sf0.01's events, 40 days apart, in 17 files, and an SQL connection that adds up in their order."""
    folder = tmp_path_factory.mktemp("repeated")
    (folder / "events.parquet").mkdir()
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE TABLE events AS SELECT event_id + k * 1000000 AS event_id, ts + k * INTERVAL 40 DAY AS ts, user_id, event_type, value, props FROM '{DATA}/sf0.01/events.parquet', range(9) r(k) ORDER BY k, event_id")
    for i in range(17):
        c.execute(f"COPY (SELECT * FROM events WHERE event_id % 17 = {i} ORDER BY event_id) TO '{folder}/events.parquet/{i:02}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["blind_candidates", "knn_exclude_overlap"])
def test_equal_windows_match_sql(name, spark, repeated, same):
    folder, c = repeated
    same(QUERIES[name](spark, folder).toPandas(), c.execute(ORACLES[name]).df())


def test_equal_windows_match_sql_over_exact_sums(spark, repeated, same):
    """In eight threads over the dealt files: values have two places, and sums of decimals do not follow threads."""
    c = duckdb.connect(config={"threads": 8})
    c.execute(f"CREATE VIEW events AS SELECT * REPLACE (value::DECIMAL(18, 2) AS value) FROM '{repeated[0]}/events.parquet/*.parquet'")
    same(QUERIES["knn_exclude_overlap"](spark, repeated[0]).toPandas(), c.execute(ORACLES["knn_exclude_overlap"]).df())


def test_sums_do_not_follow_the_order_of_rows(spark):
    schema = "symbol string, us long, id long, price double, qv double"
    parts = [[("a", 0.1), ("a", 0.2), ("b", 0.1)], [("a", 0.3), ("b", 0.2), ("b", 0.3)]]
    one, two = (spark.createDataFrame([(s, 1, 10 * i + k, x, x) for k, (s, x) in enumerate(p)], schema).coalesce(1) for i, p in enumerate(parts))
    assert {r.qv for r in bars.resample(one.unionAll(two), 1000).collect()} == {0.6}


def test_sums_of_what_is_no_decimal(spark):
    inf, nan = float("inf"), float("nan")
    cases = {"large": [9e17, 9e17, 1.0], "larger": [1e300, 1.0], "small": [1e-30, 2e-30], "inf": [inf, 1.0], "nan": [nan, 1.0], "null": [None, 0.5], "none": [None]}
    ticks = spark.createDataFrame([(s, 1, i, x, x) for s, xs in cases.items() for i, x in enumerate(xs)], "symbol string, us long, id long, price double, qv double")
    got = {r.symbol: r.qv for r in bars.resample(ticks, 1000).collect()}
    assert got.pop("nan") != got.get("nan") and got.pop("none") is None
    assert got == {"large": 1.8e18, "larger": 1e300, "small": pytest.approx(3e-30), "inf": inf, "null": 0.5}
