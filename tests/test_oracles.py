"""Every registered query against its independent SQL, over whole tables; the entry point; and the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lociframe.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in clean.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """Without the text operators, with or without the pipeline's file, the entry imports, a query runs and tests pass."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lociframe", tmp_path / "lociframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pool_sum' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    if pipeline:
        subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_sequence.py"], cwd=tmp_path, check=True)


def test_an_error_within_the_subpackage_is_an_error(tmp_path):
    """Only its absence is passed over."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lociframe", tmp_path / "lociframe", ignore=shutil.ignore_patterns("__pycache__"))
    if not (tmp_path / "lociframe" / "llm").is_dir():
        pytest.skip("there is no subpackage")
    (tmp_path / "lociframe" / "llm" / "queries.py").write_text("import no_such_module\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode and "no_such_module" in done.stderr
