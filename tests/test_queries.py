"""Every query of the reference's operators against its SQL, on the smallest tables."""

import collections
import decimal
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

from shelfdate.plans.label_queries import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ladder_exit_stage"}))  # test_ladder.py has that plan
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert collections.Counter(tuple(plain(v) for v in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["gain_loss", "run_changes", "run_log_round_trip", "score_run"])
def test_ids_of_more_than_six_digits(spark, tmp_path, name):
    """Ids that share their first six digits stay apart."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view orders as select * replace (case when o_orderkey % 5 = 0 then o_orderkey else o_orderkey + 8999000 end as o_orderkey) from '{SF}/orders.parquet'")
    c.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    names = ", ".join(f'"{n}"' for n in df.columns)
    want = c.execute(f"select {names} from ({ORACLE[name]})").fetchall()
    assert collections.Counter(tuple(plain(v) for v in r) for r in df.collect()) == collections.Counter(tuple(plain(v) for v in r) for r in want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(ORACLE) == set(QUERIES)


def test_works_without_llm():
    """The entry module imports where the llm folder and the pipeline are absent."""
    import subprocess
    import sys

    code = "import sys; sys.modules['shelfdate.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'op1_secret_scan' not in e.queries() and 'parse_ymd_sep' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
