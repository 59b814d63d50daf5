import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from loomdex import queries

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def shape(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return value


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    a = sorted(repr([shape(r[c]) for c in columns]) for r in found.collect())
    b = sorted(repr([shape(r[i]) for i in order]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["loomdex/llm", "tests/llm"], ["loomdex/llm", "tests/llm", "corpus_pipeline.py"]])
def test_works_without_the_training_data_part(tmp_path, gone):
    """With only the two folders deleted, and with the pipeline deleted too."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else os.remove)(copy / name)
    others = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.realpath(x) != os.path.realpath(REPO)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *others])}
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.SQL)), "[]"], said.stderr
    said = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True)
    assert said.returncode == 0 and "test_entry.py" in said.stdout, said.stdout
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_text.py"], cwd=copy, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout
