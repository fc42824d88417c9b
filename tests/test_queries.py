import sys
import zlib

import pytest

import __spark_entry__ as entry
from rasterloom.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in ORACLE_SQL:
        compare(df, ORACLE_SQL[name], con)
    elif name == "crc32_text":
        want = con.sql("SELECT doc_id, text FROM documents WHERE text <> ''").fetchall()
        assert sorted(tuple(r) for r in df.collect()) == sorted((i, zlib.crc32(t.encode())) for i, t in want)
    else:
        assert all(r["ok"] for r in df.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_row_filter_selection_needs_no_single_partition(spark, sf_dir):
    plan = QUERIES["png_filter_select"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan
