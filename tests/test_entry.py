"""The driver contract, with and without the text operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark)
    assert rows.columns == ["id", "ca", "ce", "instability"] and rows.count() > 0


def test_without_the_text_operators(tmp_path):
    for name in ("loomgraph", "__spark_entry__.py"):
        source = os.path.join(HERE, name)
        shutil.copytree(source, tmp_path / name) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "loomgraph" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
