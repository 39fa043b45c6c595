"""The registration, with and without the operators on training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_training_data_folders(tmp_path):
    """A copy without `timekeel/llm` lists its other queries, whether the pipeline's file is there or not."""
    for name in ("timekeel", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    for gone in (None, "corpus_pipeline.py"):
        if gone and (tmp_path / gone).exists():
            (tmp_path / gone).unlink()
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert out.returncode == 0, out.stderr
        assert int(out.stdout.split(" ")[0]) > 200 and out.stdout.strip().endswith("[]")
