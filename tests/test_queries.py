"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracles import rows_of
from lectern.plans.bindings import QUERIES
from lectern.plans.oracles import ORACLES

SMALL = Path(entry_points.SMALL)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SMALL))
    got = [tuple(r) for r in df.collect()]
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, answer.fetchall())


def test_entry_points_hold_all_queries():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["query_id", "context"]
    assert df.count() == spark.read.parquet(f"{SMALL}/benchmark.parquet").count()


def test_task_functions_travel_without_the_package(tmp_path):
    """Executors may not have the package installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lectern.operators.embedding import _token_vectors

    (tmp_path / "task.pickle").write_bytes(cloudpickle.dumps(_token_vectors(8)))
    code = (
        "import pickle, pyarrow as pa\n"
        "vectors = pickle.load(open('task.pickle', 'rb'))(pa.array(['a b']))\n"
        "assert len(vectors[0]) == 8\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": ""})
