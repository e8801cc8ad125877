"""The rest of the library stands without the text operators."""

import ast
import importlib
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_only_the_entry_and_the_pipeline_know_the_text_operators():
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT).as_posix()
        if part.startswith(("rillframe/llm/", "tests/llm/")) or part in ("__spark_entry__.py", "corpus_pipeline.py"):
            continue
        assert not [m for m in imported(path) if m.startswith(("rillframe.llm", "corpus_pipeline"))], part


def test_the_entry_lists_queries_and_oracles():
    sys.path.insert(0, str(ROOT))
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len([q for q in queries if q.startswith("q_")]) >= 50
    assert all(callable(f) for f in queries.values())


def test_the_rest_runs_without_the_text_operators(tmp_path):
    left = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=600)
    out = run("-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [x for x in q if not x.startswith('q_')], set(e.oracle_sql()) - set(q))")
    assert out.returncode == 0 and out.stdout.split(" ", 1)[1].strip() == "[] set()" and int(out.stdout.split()[0]) >= 80, out.stderr
    out = run("-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_operators.py", "tests/test_kernels.py")
    assert out.returncode == 0, out.stdout[-2000:]


def test_what_cannot_be_imported_is_left_out(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "rillframe.llm.queries", None)
    monkeypatch.delattr("rillframe.llm.queries", raising=False)
    assert all(q.startswith("q_") for q in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
