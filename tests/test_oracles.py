import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldtrace.plans import catalogue

SF = "/root/testdata/sf0.001"
QUICK = ["movement_day", "steps_in_segments", "qc_metrics", "clean_audit", "interpolate", "social_rows", "contacts", "resource_visits", "append_paddock", "epoch_merge", "group_summary", "playback_tails"]


def text(v):
    return "nan" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(text, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 397
    assert set(entry.oracle_sql()) <= set(entry.queries())
