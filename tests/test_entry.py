"""The driver's entry: what is there without the corpus folders, and that errors inside them are not hidden."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(root):
    code = "import __spark_entry__ as E; print(sorted(E.queries())); assert set(E.oracle_sql()) <= set(E.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)


def _copy(tmp_path, name, leave_out=()):
    to = tmp_path / name
    shutil.copytree(ROOT / "lakeops", to / "lakeops", ignore=shutil.ignore_patterns("__pycache__", *leave_out))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def test_without_the_corpus_folders(tmp_path):
    out = _names(_copy(tmp_path, "bare", ["llm"]))
    assert out.returncode == 0, out.stderr
    assert "q_access_count" in out.stdout and "op1_" not in out.stdout


def test_a_broken_import_inside_is_an_error(tmp_path):
    to = _copy(tmp_path, "broken")
    (to / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in _names(to).stderr
