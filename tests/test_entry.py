"""The registered queries load without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(folder):
    shutil.copytree(os.path.join(ROOT, "sparkrag"), os.path.join(folder, "sparkrag"),
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); "
         "print(len(q) > 150, len(q) == len(e.oracle_sql()), 'pipeline' in q, 'op1_neighbours' in q)"],
        cwd=folder, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True", "False", "False"], said.stderr
