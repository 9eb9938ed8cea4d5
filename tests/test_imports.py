"""Names that functions import when they run exist."""

import ast
import importlib
from pathlib import Path

import riskflow


def test_every_imported_name_exists():
    root = Path(riskflow.__file__).parent
    missing = []
    for file in root.rglob("*.py"):
        for node in ast.walk(ast.parse(file.read_text())):
            if isinstance(node, ast.ImportFrom) and (node.module or "").startswith("riskflow"):
                module = importlib.import_module(node.module)
                for a in node.names:
                    try:
                        hasattr(module, a.name) or importlib.import_module(f"{node.module}.{a.name}")
                    except ImportError:
                        missing.append((file.name, node.module, a.name))
    assert not missing
