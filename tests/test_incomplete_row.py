"""Queries over a grid whose last row is incomplete, against their SQL."""

import os

import duckdb
import pytest

from skerry.plans import catalog
from tests.test_catalog import SF, TABLES, _rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module", params=[329, 303])
def tables(request, tmp_path_factory):
    """13 rows of 25 and 4 points, which share a tile with whole rows; 12 rows and 3 points, which have one of their own."""
    folder = str(tmp_path_factory.mktemp("incomplete"))
    con = duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "embeddings":
            n = con.sql(f"SELECT count(*) FROM '{SF}/{t}.parquet'").fetchall()[0][0]
            again = "[(v * (1 + (k * 7919 % 13) / 29))::FLOAT for v in embedding]"
            rows = f"SELECT k AS vec_id, {again} AS embedding, label FROM '{SF}/{t}.parquet' JOIN range({request.param}) AS r(k) ON vec_id = k % {n}"
        con.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


NAMES = [
    "bandpass", "denkf_tiles_one_obs", "ens_cov_corr", "ens_cov_raw", "etkf_records_one_obs", "etkf_tiles_one_obs", "grid_laplacian", "grid_map_factors", "grid_refine", "grid_warp", "local_factors",
    "local_obs_topk", "local_pairs", "nearest_node", "power_spectrum", "rankine_vortex", "task_split", "tile_halo_obs", "wind_from_pressure",
]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    folder, con = tables
    got = catalog.QUERIES[name](spark, folder)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())
