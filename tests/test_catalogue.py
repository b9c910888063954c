"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from voxelweave.jobs import catalogue

FOLDER = "/root/testdata/sf0.001"
#: Queries that find nothing in tables so small.
MAY_BE_EMPTY = ("anti_missing", "contradictions", "bfs_seed", "overlap_edges", "star_edges", "duplicated_keys", "radius_pairs", "radial_crop", "enhanced_voxels")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(records):
    out = []
    for r in records:
        out.append(tuple(round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else None for v in r))
    return sorted(out, key=repr)


def compare(spark, db, name, folder):
    got = catalogue.queries()[name](spark, folder)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    have = rows(got.select(*[f"`{c}`" for c in cols]).collect())
    assert have == rows(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert have or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, db, name):
    compare(spark, db, name, FOLDER)


@pytest.mark.parametrize("name", ["shell_features", "grayscale_features", "review_order"])
def test_same_rows_on_larger_tables(spark, name):
    """Queries whose rounding small tables do not try."""
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    compare(spark, con, name, "/root/testdata/sf0.01")
