"""The driver's contract: registered queries, and the tree without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


def counted(at: Path) -> tuple[int, int]:
    done = subprocess.run([sys.executable, "-c", CODE], cwd=at, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120, check=True)
    a, b = done.stdout.split()[-2:]
    return int(a), int(b)


RUN = """
import os, __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(s).count() > 0
q = e.queries()
print(*(q[n](s, os.environ["SF"]).count() for n in ("facts", "cell_parsing")))
"""


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_tree_without_extras(tmp_path, gone):
    copy = tmp_path / "tree"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    rest, none = counted(copy)
    assert rest > 0 and none == 0
    everything, extras = counted(ROOT)
    assert everything == rest + extras


def test_queries_of_the_tree_without_extras(tmp_path, sf):
    copy = tmp_path / "tree"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    env = os.environ | {"PYTHONPATH": str(copy), "SF": sf}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=copy, env=env, capture_output=True, text=True, timeout=300, check=True)
    assert all(int(n) > 0 for n in done.stdout.split()[-2:])
