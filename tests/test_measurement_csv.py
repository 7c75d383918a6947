"""Six decimals of the measurement rows, where the product and the shown decimals round to different sides."""

from __future__ import annotations

import duckdb

from corpusloom.plans import catalog


def test_csv_rounds_as_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(catalog.oracles()["whole_measurement_csv"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["whole_measurement_csv"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
