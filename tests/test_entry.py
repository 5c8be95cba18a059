"""The driver contract holds, with and without the training-data package."""

import __spark_entry__ as entry
from adherix.plans import registry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_core_does_not_import_the_training_package():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "adherix.llm" not in p.read_text(), p


def test_the_rest_stands_without_the_training_package(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(registry.__file__).parents[2]
    for name in ("adherix", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 60 and not [n for n in q if n[0] == 'p' and n[1].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
