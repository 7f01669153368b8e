"""The entry module works with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["branch", "_id", "timestamp"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "trussline", tmp_path / "trussline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit()); print(len(q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout) > 80


def test_the_library_does_not_import_the_corpus_operators():
    for f in (ROOT / "trussline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
