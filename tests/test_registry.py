"""The registry must import without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); print(*q)"


def names(tree) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return set(done.stdout.split())


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_import_without_parts(tmp_path, left_out):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda _, found: [x for x in found if x in left_out or x in (".git", "__pycache__")])
    left = names(tree)
    assert "rag_batch" in left
    assert "pipeline" not in left
    assert any(n.startswith("op") and "_" in n and n[2].isdigit() for n in left) == ("llm" not in left_out)
