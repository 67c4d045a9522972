"""Account derivation on a hand-made order history, against the DuckDB text
of the same mapping and against hand-computed rows."""

import datetime as dt
import os
import tempfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from retentia.sources.accounts import ACCOUNTS_SQL, account_table


def _history_folder() -> str:
    ts = dt.datetime
    folder = tempfile.mkdtemp(prefix="retentia-accounts-")
    tables = {
        "customer": {
            "c_custkey": [1, 2, 3, 4, 5],
            "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        },
        "orders": {
            # 1: two 2000 orders and a later one; 2: only a later order;
            # 3: none; 4: a 2000 order without line items; 5: only 1999
            "o_orderkey": [10, 11, 12, 20, 40, 50],
            "o_custkey": [1, 1, 1, 2, 4, 5],
            "o_orderstatus": ["F", "P", "O", "O", "P", "F"],
            "o_orderdate": [ts(2000, 3, 1), ts(2000, 12, 31, 23), ts(2001, 1, 1), ts(2001, 6, 1), ts(2000, 7, 4), ts(1999, 12, 31)],
        },
        "lineitem": {
            "l_orderkey": [10, 10, 11, 12, 20, 50],
            "l_quantity": [5.0, 7.0, 12.0, 1.0, 3.0, 9.0],
            "l_returnflag": ["R", "N", "R", "R", "N", "R"],
        },
    }
    for name, cols in tables.items():
        pq.write_table(pa.table(cols), os.path.join(folder, f"{name}.parquet"))
    return folder


def test_account_mapping_matches_sql_and_hand_rows(spark):
    folder = _history_folder()
    got = sorted(tuple(r) for r in account_table(spark, folder).collect())

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t + '.parquet')}')")
    want = sorted(con.execute("WITH " + ACCOUNTS_SQL + " SELECT * FROM accounts").fetchall())
    assert got == want

    by_id = {r[0]: r for r in got}
    # hours = (5 + 7 + 12) / 12, two 2000 orders, last seen 2000-12-31 -> 1 day,
    # two returned lines, one pending order, ordered again in 2001
    assert by_id[1] == (1, 2.0, 2.0, 1.0, 2.0, 1.0, "starter", 1)
    # only a later order: no activity at all, but renewed
    assert by_id[2] == (2, None, None, None, None, None, "growth", 1)
    assert by_id[3] == (3, None, None, None, None, None, "Business ", 0)
    # a 2000 order without line items: counted, but no quantities
    assert by_id[4] == (4, None, 1.0, 181.0, None, 1.0, " ENTERPRISE", 0)
    assert by_id[5] == (5, None, None, None, None, None, "legacy", 0)
