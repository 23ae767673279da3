"""The entry without the training-data subpackage, or without a package that only it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

from stocklens.plans import oracle, registry

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
from importlib.abc import MetaPathFinder

class Blocked(MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["stocklens.llm", "corpus_pipeline", "public_tokenizers", "ahocorasick", "xxhash"])
def test_core_queries_stay(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = map(int, done.stdout.split())
    if "stocklens.llm" in done.stderr or name in done.stderr:
        assert (queries, sql) == (len(registry.queries()), len(oracle.oracle_sql()))
    else:  # the package is not needed
        assert queries >= len(registry.queries())


def test_wrong_names_inside_are_errors():
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name="stocklens.functions.columns")], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0
