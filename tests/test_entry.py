"""The entry module imports on its own: without Spark's jars, and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

_NO_JARS = """
import importlib.util, sys, types
import pyspark
pyspark.__file__ = "/nowhere/pyspark/__init__.py"
import __spark_entry__ as e
assert e.queries() and e.oracle_sql()
"""

_NO_SUBPACKAGE = """
import sys
sys.modules["quillwork.llm"] = None
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("quillwork.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
del sys.modules["quillwork.llm"]
import __spark_entry__ as e
assert "word_count" in e.queries()
assert "pipeline" not in e.queries()
"""


def _run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_imports_without_jars():
    _run(_NO_JARS)


def test_imports_without_the_optional_subpackage():
    _run(_NO_SUBPACKAGE)
