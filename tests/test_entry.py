"""The driver contract and a DuckDB cross-check on the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as E
from corpusgate.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "rows", "median_chars", "short_share", "dup_share",
                                               "long_share"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ["row_stats", "eval_gate", "source_verdicts", "pr_violations", "weighted_mixture",
                                 "contamination", "heldout_violations", "hub_entry_findings"])
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))
                  for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    exp = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (row[names.index(c)] for c in cols))
                  for row in res.fetchall()), key=repr)
    assert got == exp
