"""The entry module's guard hides no import error but the subpackage's own absence."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("pyspark.ml"):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__
"""


def test_other_missing_modules_are_errors():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "gone" in done.stderr
