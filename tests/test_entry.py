"""The entry point, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from tidemark.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_it_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True, check=False)
    n, m, any_op = said.stdout.split() if said.returncode == 0 else (0, 0, said.stderr)
    assert int(n) == len(catalogue.QUERIES) and int(m) == len(catalogue.SQL) and any_op == "False", said.stderr


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["left", "right", "bucket", "votes", "runner_up"]
