"""The entry point with and without the corpus folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len([k for k in q if k.startswith('op')]), 'pipeline' in q, set(o) <= set(q))"


def copied(to: Path) -> Path:
    return Path(shutil.copytree(REPO, to / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache")))


def said(at: Path, code: str = COUNT) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=300)


def test_without_the_corpus_folders(tmp_path):
    at = copied(tmp_path)
    for folder in ("fieldtrace/llm", "tests/llm"):
        shutil.rmtree(at / folder, ignore_errors=True)
    got = said(at)
    assert got.returncode == 0, got.stderr
    count, corpus, pipeline, covered = got.stdout.split()
    assert int(count) >= 57 and (corpus, pipeline, covered) == ("0", "False", "True")


@pytest.mark.parametrize("missing", ["public_tokenizers", "regex", "zstandard", "tiktoken", "tokenizers", "sentencepiece"])
def test_without_a_package_of_the_corpus_operators(tmp_path, missing):
    at = copied(tmp_path)
    got = said(at, f"import sys; sys.modules[{missing!r}] = None; " + COUNT)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout.split()[0]) >= 57


def test_a_fault_inside_is_not_swallowed(tmp_path):
    at = copied(tmp_path)
    (at / "corpus_pipeline.py").write_text("import no_such_package\n")
    assert "no_such_package" in said(at).stderr
