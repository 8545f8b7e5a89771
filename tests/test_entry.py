"""The driver's contract holds with and without the training-data part."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import json, sys, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql()), [m.__file__ for n, m in sys.modules.items() if n.split('.')[0] in ('tracegraph', 'corpus_pipeline', '__spark_entry__')]]))"


@pytest.mark.parametrize("gone", [("tracegraph/llm", "tests/llm"), ("tracegraph/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_parts(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *[Path(g).name for g in gone if g.endswith(".py")]))
    for g in gone:
        shutil.rmtree(tmp_path / "repo" / g, ignore_errors=True)
    own = {k: v for k, v in os.environ.items() if not k.startswith("PYTHON")}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", env=own, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    registered, twins, files = json.loads(done.stdout)
    assert files and all(Path(f).is_relative_to(tmp_path / "repo") for f in files)
    assert "dep_edges" in registered and "pipeline" not in registered and set(twins) <= set(registered)
    assert any(n.startswith("op1_") for n in registered) == ("tracegraph/llm" not in gone)
