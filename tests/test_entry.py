"""The registry with and without the training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline')); import bench, compare"


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_the_part(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "bench.py", "compare.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip() == "[]"
