"""The driver's contract stands without the training-data operators, and without packages that only they need."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder, before=""):
    got = subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, '.'); {before}{NAMES}"], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-2000:]
    return [set(x.split()) for x in got.stdout.splitlines()]


def is_core(name):
    return name != "pipeline" and not (name.startswith("op") and name[2].isdigit())


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    """A copy of the repository without the pipeline and the two folders."""
    to = tmp_path_factory.mktemp("copy") / "repo"
    shutil.copytree(ROOT, to, ignore=lambda d, names: {n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache")})
    return to


def test_core_queries_stand_alone(without):
    queries, sql = listed(without)
    assert queries == {n for n in listed(ROOT)[0] if is_core(n)} and sql < queries
    found = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=without, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]


@pytest.mark.parametrize("package", ["zstandard", "xxhash", "regex"])
def test_core_queries_without_a_package(package):
    queries, _ = listed(ROOT, f"sys.modules['{package}'] = None; ")
    assert queries and all(is_core(q) or q == "pipeline" for q in queries)  # the pipeline needs fewer packages


def test_nothing_else_imports_the_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallyforge")):
        for name in names:
            if name.endswith(".py") and "llm" not in folder.split(os.sep):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "tallyforge.llm" not in f.read(), name
