"""Every registered query on the smallest tables, against its oracle where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import canon, oracle

from jobs import queries as jobs
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


QUERIES, ORACLES = catalog.queries() | jobs.queries(), catalog.oracle_sql() | jobs.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    sql = ORACLES.get(name)
    if sql:
        want = oracle(sql, SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry_without_the_llm_folders():
    import subprocess

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'torus_corpus_topology' in q and not any(k.startswith('op') for k in q) and not any(k.startswith('op') for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
