import subprocess
import sys


def test_queries_run_and_names_match(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


def test_the_engine_stands_without_the_training_data_operators(tmp_path):
    """A copy without both folders and the pipeline still imports and answers."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "signalmill", tmp_path / "signalmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
