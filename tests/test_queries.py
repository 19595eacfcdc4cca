"""Every registered query against its SQL on the smallest tables (ADLOOM_SAMPLE=1 runs a few)."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
DATA = "/root/testdata/sf0.001"

from adloom.plans.catalog import load_all, runner  # noqa: E402

CATALOG = load_all()
SAMPLE = ["calls_attribution", "cost_per_lead", "cpl_latest_vs_previous", "alerts_active", "client_heatmap_90d", "pacing_context",
          "budget_rollover", "user_access", "ticket_board", "rule_verdicts", "upserted_table", "streamed_events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert [n for n, q in CATALOG.items() if q.sql is None] == []


@pytest.mark.parametrize("name", SAMPLE if os.environ.get("ADLOOM_SAMPLE") else list(CATALOG))
def test_matches_sql(spark, duck, name):
    from check import normal

    df = runner(CATALOG[name])(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(CATALOG[name].sql)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(normal(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want
