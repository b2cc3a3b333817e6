import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_text_operators(tmp_path):
    """The registry works when the optional subpackage, its tests and the pipeline are gone, or some of them."""
    for name, gone in (("all", ["seqframe/llm", "tests/llm", "corpus_pipeline.py"]), ("folders", ["seqframe/llm", "tests/llm"])):
        at = tmp_path / name
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", *(g.split("/")[-1] for g in gone)))
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); assert not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
