"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from tablelearn.plans import catalog as c; " \
        "print(set(e.queries()) == set(c.queries()), set(e.oracle_sql()) == set(c.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_llm(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "tablelearn"), tmp_path / "tablelearn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr
