import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """Everything but the llm subpackage and the pipeline, copied: the queries can be listed."""
    import shutil

    shutil.copytree(ROOT / "stanzagraph", tmp_path / "stanzagraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, subset, llm = out.stdout.split()
    assert int(n) > 50 and subset == "True" and llm == "False"
