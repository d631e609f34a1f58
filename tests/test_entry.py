"""The driver's entry points, also without the parts that may be absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'flagship' in q, set(e.oracle_sql()) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    for name in ("weftlink", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source) and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    found = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    count, flagship, known, ops, has = found.stdout.split()
    assert int(count) > 40 and (flagship, known, ops, has) == ("True", "True", "False", "False")


def test_every_sql_has_a_query():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
