"""The driver entry without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and 'pipeline' not in q and set(s) <= set(q) and not any(n.startswith('op1') for n in q); assert not any('llm' in m for m in sys.modules if m.startswith('sparrowdex'))"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (copy / gone).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
