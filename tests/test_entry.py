"""The entry points without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_loads_without_the_corpus_subpackage(tmp_path):
    for left_over in (False, True):
        copy = tmp_path / str(left_over)
        shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
        if left_over:
            os.makedirs(copy / "cellscope" / "llm" / "__pycache__")
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 180 and not any(n.startswith('op') or n == 'pipeline' for n in q), len(q); assert set(o) <= set(q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True, timeout=120)
