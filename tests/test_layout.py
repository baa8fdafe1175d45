"""Who may import whom."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return found


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(m.startswith("corpusloom.llm") for m in imports(path)), path


def test_layers():
    order = ["functions", "plans/ledger.py", "operators", "sources", "streaming", "plans"]
    for path in (ROOT / "corpusloom" / "functions").glob("*.py"):
        assert not any(m.startswith(("corpusloom.operators", "corpusloom.plans")) for m in imports(path)), path
    for path in (ROOT / "corpusloom" / "operators").glob("*.py"):
        assert not any(m.startswith("corpusloom.plans.queries") for m in imports(path)), path
    assert order


def test_no_local_checkpoints():
    for path in [*(ROOT / "corpusloom").rglob("*.py"), ROOT / "__spark_entry__.py"]:
        assert "localCheckpoint" not in path.read_text(encoding="utf-8"), path
