import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quiverine.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def values(rows, columns):
    return sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[c] for c in columns)]) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got = catalog.QUERIES[name](spark, DATA)
    asked = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(got.columns)
    columns = sorted(names)
    expected = [dict(zip(names, r, strict=True)) for r in asked.fetchall()]
    assert values(got.collect(), columns) == values(expected, columns)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_the_flagship_gives_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['quiverine.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) == len(catalog.QUERIES)
