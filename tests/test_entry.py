import importlib
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_only_the_llm_package_imports_itself():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tessella\.llm|from \.llm", path.read_text()), path


def test_the_rest_works_without_the_llm_package():
    code = "import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('p4_') for k in e.queries()); assert 'p1_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
