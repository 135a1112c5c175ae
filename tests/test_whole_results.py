"""Queries that do their whole job, and results that neither gaps nor the order of rows change."""

import os
from datetime import datetime

import duckdb
import pytest

from skerry.operators import fields
from skerry.plans import catalog
from skerry.sources import carriers
from tests.test_catalog import SF, _rows

sample = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@sample
def test_mesh_interpolate_has_all_members_at_all_observations(spark):
    got = catalog.mesh_interpolate(spark, SF)
    events = carriers.table(spark, SF, "events").count()
    assert got.count() == got.select("obs_id", "mem").distinct().count() == events * carriers.MEMBERS
    assert got.where("value is null").count() == 0


def test_box_sums_reach_past_gaps(spark):
    """Three rows and two points of a fourth; the box at (3, 2) holds (1, 3), below which is a gap at (3, 3)."""
    nx, half = 5, 2
    cells = {(i, j): 1.0 + i + 10 * j for j in range(4) for i in range(nx) if j < 3 or i < 2}
    field = spark.createDataFrame([(0, i, j, v) for (i, j), v in cells.items()], "mem int, i int, j int, value double")
    got = {(r.i, r.j): r.total for r in fields.box_sums(field, ["mem"], half).collect()}
    assert got == {(i, j): sum(v for (a, b), v in cells.items() if abs(a - i) <= half and abs(b - j) <= half) for i, j in cells}


def test_config_notation_of_odd_events(spark, tmp_path):
    """Ids that are null or negative, and types with blanks, line ends or capitals, against the SQL."""
    kinds = [None, "", " yes ", "yes", "INF", "inf", " inf", "-Inf", "1e5", "1e5\n", " 1E2", "2.e-3", "Off", "click"]
    rows = [(k, "click") for k in (None, *range(-17, 18))] + [(6 + 8 * n, kind) for n, kind in enumerate(kinds, 100)]
    events = spark.createDataFrame([(k, datetime(2024, 1, 1), kind) for k, kind in rows], "event_id bigint, ts timestamp, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.config_notation(spark, str(tmp_path))
    assert _rows(got.columns, got.collect()) == _rows(got.columns, con.sql(catalog.ORACLE_SQL["config_notation"]).select(*got.columns).fetchall())


def test_category_total_does_not_hang_on_the_order_of_rows(spark):
    orders = [[0.06, 0.01, 0.01, 0.01, 0.06], [0.06, 0.06, 0.01, 0.01, 0.01], [0.01, 0.06, 0.01, 0.06, 0.01], [0.05, 0.1], [0.14, 0.0099999]]
    rows = [(k, v) for k, values in enumerate(orders) for v in values]
    cells = spark.createDataFrame(rows, "pid int, f double").coalesce(1)
    got = {r.pid: r.total for r in fields.category_total(cells, ["pid"], "f", 0.15).collect()}
    assert got == {0: pytest.approx(0.15), 1: pytest.approx(0.15), 2: pytest.approx(0.15), 3: pytest.approx(0.15), 4: 0.0}
