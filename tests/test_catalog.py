import os
import shutil
import subprocess
import sys

import pytest
from helpers import same

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir) == ""


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_without_the_corpus_operators(tmp_path):
    """The other queries and their SQL are there when the corpus subpackage is deleted, whatever else is left."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q and 'pipeline' not in q and 'q3_prioritized_items' in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["account_id", "item_id", "status", "priority_score"]
    assert set(e.oracle_sql()) <= set(e.queries())
