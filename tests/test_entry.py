"""The driver's contract on a copy of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'), sorted(set(o) - set(q)))"


def run_in(folder):
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})


def test_without_the_folders(tmp_path):
    for with_pipeline in (False, True):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(os.path.join(ROOT, "airlens"), copy / "airlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
        if with_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
        found = run_in(copy)
        assert found.returncode == 0, found.stderr[-2000:]
        count, rest = found.stdout.strip().split(" ", 1)
        assert int(count) > 100 and rest == "[] []"
