"""Every query with SQL gives DuckDB's rows; every other one runs; the library stands without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import compare
import pytest

from lexloom.plans import q_compare, q_evaluate, q_more, q_prepare, q_report, q_respond, q_rules, q_segment, q_text, q_verify, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = compare.rows_of_spark(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLE:
        assert compare.difference(got, compare.rows_of_duck(db, registry.ORACLE[name])) == ""
    assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['lexloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rules_run' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
