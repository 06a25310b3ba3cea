import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    if Path(ROOT, "breachline", "llm").is_dir():
        assert {f"op{n}" for n in range(1, 11)} <= {k.partition("_")[0] for k in known} and "pipeline" in known


def test_entry_without_training_data(tmp_path):
    """The rest imports and registers its queries when the training-data folders are gone."""
    for name in ("__spark_entry__.py", "breachline"):
        at = ROOT / name
        (shutil.copytree if at.is_dir() else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "breachline" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'goal_reached' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_training_data():
    for path in (ROOT / "breachline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "breachline.llm" not in path.read_text(encoding="utf-8"), path
