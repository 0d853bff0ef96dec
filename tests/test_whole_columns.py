import duckdb
import pytest

from gridcalc.queries import ORACLES, QUERIES, SPECS

SF_DIR = "/root/testdata/sf0.01"
LOOKUPS = ["lookup_exact", "lookup_approx_le", "lookup_approx_ge", "lookup_in_if", "index_fixed", "match_exact", "match_approx", "vlookup_exact"]


@pytest.mark.parametrize("name", [f"{x}_whole" for x in LOOKUPS] + [x for x in SPECS if x.endswith(("rf_whole", "ff_whole"))])
def test_whole_columns_equal_sql(spark, name):
    con = duckdb.connect()
    table = SPECS[name].table
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet(['{SF_DIR}/{table}.parquet'])")
    want = dict(con.execute(ORACLES[name]).fetchall())
    got = {r.row_id: r.value for r in QUERIES[name](spark, SF_DIR).collect()}
    assert got.keys() == want.keys()
    wrong = [(k, got[k], v) for k, v in want.items() if (got[k] is None) != (v is None) or v is not None and abs(got[k] - v) > 1e-9 * max(1, abs(v))]
    assert not wrong, (len(wrong), wrong[:3])
