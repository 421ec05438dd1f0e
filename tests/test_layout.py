import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "prefixory", tmp_path / "prefixory", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'prefix_topk_basic' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "prefixory").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_no_local_checkpoints():
    for path in [*(ROOT / "prefixory").rglob("*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path
