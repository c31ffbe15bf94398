"""The rest works with the corpus operators taken away, with or without the pipeline that is built on them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as e
from quirework.session import local_session
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
s = local_session("isolation", cpus=2, memory="1g")
assert e.entry(s).columns
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_corpus_operators(tmp_path, pipeline):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
