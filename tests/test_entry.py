"""The driver contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["c", "works"] and out.count() > 0


def test_without_the_optional_part(tmp_path):
    root = os.path.dirname(entry.__file__)
    for gone in (("llm", ".git"), ("llm", ".git", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__", ".pytest_cache", *gone))
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
