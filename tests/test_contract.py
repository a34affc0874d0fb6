"""The driver's contract without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_subpackage(tmp_path):
    for folder in ("vigilog", "queryset"):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_alerts' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


@pytest.mark.parametrize("library", ["tiktoken", "xxhash", "regex", "public_tokenizers"])
def test_entry_without_a_library_of_the_optional_subpackage(tmp_path, library):
    """All other queries stay where a library that only the subpackage uses is absent."""
    (tmp_path / f"{library}.py").write_text(f"raise ModuleNotFoundError('no {library}', name='{library}')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_alerts' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_subpackage():
    for folder in ("vigilog", "queryset"):
        for at, _, names in os.walk(f"{ROOT}/{folder}"):
            if not at.startswith(f"{ROOT}/vigilog/llm"):
                for name in names:
                    if name.endswith(".py"):
                        with open(f"{at}/{name}") as file:
                            assert "llm" not in file.read(), name
