"""Every registered query against its check statement."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA
from tollbook import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def expected():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    out = {}
    for name, sql in entry.oracle_sql().items():
        if name not in registered.queries():
            continue
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        out[name] = (sorted(names), sorted((tuple(row[i] for i in order) for row in cur.fetchall()), key=str))
    return out


def actual(spark, name):
    df = entry.queries()[name](spark, TESTDATA)
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def differences(spark, expected):
    def one(name):
        cols, rows = actual(spark, name)
        want_cols, want = expected[name]
        same = len(rows) == len(want) and all(
            all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b)) for a, b in zip(rows, want))
        return None if cols == want_cols and same else name
    with ThreadPoolExecutor(8) as pool:
        return [n for n in pool.map(one, expected) if n]


def test_all_queries(spark, expected):
    assert differences(spark, expected) == []


def test_small_blocks(spark, expected, monkeypatch):
    """The same plans with blocks so narrow that every session has several."""
    plain = registered.workspace
    monkeypatch.setattr(registered, "workspace", lambda s, d, **k: plain(s, d, block_span=50))
    names = {n: v for n, v in expected.items() if not n.startswith(("ingest", "slice", "probe"))}
    assert differences(spark, names) == []


def test_rows_only_queries(spark):
    only = set(registered.queries()) - set(entry.oracle_sql())
    assert only == {
        "probe_bash_measures", "probe_bash_by_bucket", "probe_bash_by_agent", "probe_extrapolation_high_ratio_results", "probe_extrapolation_compressible_redundancy"}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.agent for r in rows} == {"ALL", "claude_code", "codex", "opencode", "cursor"}


def test_queries_can_be_listed_without_a_session():
    """In a process of its own, as this one has a session."""
    import subprocess
    import sys
    from pathlib import Path

    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
