"""The driver's entry also works where the training-data subpackage was taken out."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("quillmark.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name.split(".queries")[0])
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "hybrid_retrieve" in e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_sql_has_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 60


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
