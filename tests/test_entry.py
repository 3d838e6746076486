"""The entry module works without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith({missing!r}):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as E
names = set(E.queries())
assert "clean_posts" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(E.oracle_sql()) <= names
"""


def run(missing):
    return subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage():
    done = run("threadmill.llm")
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for f in ROOT.glob("threadmill/**/*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "threadmill.llm" not in f.read_text(), f
