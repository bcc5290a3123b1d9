"""The report of stages: whole percentiles, stages without a name, without durations, of copies."""

import datetime as dt
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from groundwork.operators import ledgers as G
from groundwork.plans.registry import ORACLE_SQL, QUERIES

NAN = float("nan")
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events():
    at = dt.datetime(2024, 1, 1)
    told = [("view", float(i * i % 997) / 7) for i in range(200)] + [("same", 7.25)] * 30 + [("none", None)] * 3 + [("one", -0.5), ("one", None), (None, 1.0), (None, 2.0), (None, 41.0)]
    told += [("error", v) for v in (1.0, 2.0, 3.0, NAN, 9.0, float("-inf"))] + [("error", float(i)) for i in range(40)] + [("lost", NAN), ("lost", NAN)]
    return [(i, at, None if i % 5 == 0 else i, kind, v, "") for i, (kind, v) in enumerate(told)]


def plain(rows):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


def test_every_stage_has_its_percentile(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(events(), EVENTS).repartition(3).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = duck.execute(ORACLE_SQL["stage_report"])
    cols = [c[0] for c in want.description]
    got = QUERIES["stage_report"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(cols) and "p95" in cols
    assert plain(got.select(*cols).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_neighbours_in_ranges_of_their_own(spark, q):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = {("two", None): [1.0, 2.0], ("many", 1): [float(i % 101) for i in range(1000)], (None, 1): [3.0, None, 3.0, 8.0]}
    d = spark.createDataFrame([(*k, v) for k, vs in rows.items() for v in vs], "a string, b int, duration_ms double")
    got = {(r["a"], r["b"]): r["value"] for r in G.exact_quantile(d, ["a", "b"], q).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, vs in rows.items():
        v = sorted(x for x in vs if x is not None)
        at = (len(v) - 1) * q
        low, high = v[math.floor(at)], v[math.ceil(at)]
        assert got.pop(k) == pytest.approx(low + (high - low) * (at - math.floor(at)))
    assert got == {}


def test_values_without_bounds(spark):
    inf = float("inf")
    rows = [[inf, inf, 1.0], [NAN, 1.0], [inf, inf], [1.0, 2.0, NAN], [-inf, 2.0], [-inf, inf]]
    d = spark.createDataFrame([(k, v) for k, r in enumerate(rows) for v in r], "k int, duration_ms double")
    got = {r["k"]: str(r["value"]) for r in G.exact_quantile(d, ["k"], 0.95).collect()}
    duck = duckdb.connect()
    want = {k: duck.execute("SELECT quantile_cont(x, 0.95) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [r]).fetchone()[0] for k, r in enumerate(rows)}
    assert got == {k: str(v) for k, v in want.items()}


def test_a_long_stage_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    d = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 1.5).alias("duration_ms"))
    made = G.exact_quantile(d, ["k"], 0.95)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    sorted_by = re.findall(r"windowspecdefinition\(([^)]*?_v#\d+)", plan)
    assert "percentile" not in plan and "collect_list" not in plan
    assert sorted_by and all("_part#" in w for w in sorted_by)
    assert [tuple(r) for r in made.collect()] == [("k", pytest.approx(19_999 * 0.95 * 1.5))]
