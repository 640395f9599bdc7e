import ast
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() > 0


def test_nothing_else_imports_the_llm_package():
    for p in (ROOT / "notefathom").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] + [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") for n in names), p


def test_entry_without_the_llm_package():
    code = "import sys; sys.modules['notefathom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
