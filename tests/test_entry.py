import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphcq.queries import CPQS, CQS, QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 22649


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(CQS) | set(CPQS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    got, want = QUERIES[name](spark, str(DATA)), tables.execute(SQL[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    names = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(zip(*(want.column(n).to_pylist() for n in names), strict=True), key=key)


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The operators and the pipeline may be taken away."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('graphcq.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert out.split()[-2:] == [str(len(QUERIES)), "True"]


def test_nothing_imports_the_training_data_operators():
    sources = [p for p in (ROOT / "graphcq").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in sources if re.search(r"graphcq\.llm|from \.llm", p.read_text())]
